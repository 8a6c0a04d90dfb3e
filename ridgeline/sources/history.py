"""A table that keeps what was true when, and what was known when.

Each row says that a key had some values from ``valid_from`` up to ``valid_to``,
and that the table held so from ``recorded_from`` up to ``recorded_to``; null is
no end.  A merge never changes what was recorded before: rows that no longer
hold are closed at the time of the merge, and those that now hold are opened.
Files are in buckets by key, and a merge rewrites the buckets in which a row was
closed or opened.

Spark replaces bucket folders one after the other.  A merge that ended half-way
is run again: keys that it had moved already are as they should be.  Readers
that need one step for all are served by ``versions``.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import _at, materialize

TIMES = ("valid_from", "valid_to", "recorded_from", "recorded_to")
BUCKET = "bucket_"


def _moment(at: datetime) -> Column:
    """A time without a zone, in the session's."""
    return F.lit(at.isoformat(sep=" ")).cast("timestamp")


class History:
    """The history in ``path`` of ``values`` by ``keys``; ``buckets`` must stay
    the same for all merges."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], values: list[str], buckets: int = 32):
        self.spark, self.path, self.keys, self.values, self.buckets = spark, path.rstrip("/"), keys, values, buckets

    def read(self) -> DataFrame | None:
        """All rows ever recorded; None before the first merge."""
        files, at = _at(self.spark, self.path)
        some = files.exists(at) and any(s.getPath().getName().startswith(BUCKET) for s in files.listStatus(at))
        return self.spark.read.parquet(self.path) if some else None

    def as_of(self, valid_at: datetime, known_at: datetime | None = None) -> DataFrame:
        """keys, values, valid_from and valid_to that held at ``valid_at``, as
        the table said at ``known_at`` (now, if not given)."""
        rows = self.read()
        if rows is None:
            raise ValueError(f"no history in {self.path}")

        def holds(begin: str, end: str, at: Column) -> Column:
            return (F.col(begin) <= at) & (F.col(end).isNull() | (F.col(end) > at))

        known = F.col("recorded_to").isNull() if known_at is None else holds("recorded_from", "recorded_to", _moment(known_at))
        return rows.filter(known & holds("valid_from", "valid_to", _moment(valid_at))).select(*self.keys, *self.values, "valid_from", "valid_to")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def merge(self, changes: DataFrame, recorded_at: datetime) -> list[int]:
        """Record that keys have new values from ``valid_from`` on, until the
        next change of the key that is known; gives the buckets rewritten.

        Changes may come in any order and lie before others.  One of a key and
        time that are known replaces what they had; of several such changes the
        one of largest values counts.  Changes that say what is known already,
        as when a merge is run again, do nothing.  Rows with a null key or
        ``valid_from`` are dropped.  ``recorded_at`` may not lie before an
        earlier merge.  Other columns are ignored.
        """
        keys, values, spark = self.keys, self.values, self.spark
        at, was = _moment(recorded_at), F.col("recorded_from")
        kinds = {f.name: f.dataType.simpleString() for f in changes.schema}
        fresh = changes.dropna(subset=[*keys, "valid_from"]).groupBy(*keys, F.col("valid_from").cast("timestamp").alias("valid_from")).agg(F.max(F.struct(*values)).alias("v"))
        fresh = materialize(fresh.select(*keys, "valid_from", "v.*").withColumn(BUCKET, self._bucket()), "changes")
        old = self.read()
        if old is None:
            schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*keys, *values)), *(f"{t} timestamp" for t in TIMES), f"{BUCKET} int"])
            old = spark.createDataFrame([], schema)
        else:
            if not old.filter((F.col("recorded_from") > at) | (F.col("recorded_to") > at)).isEmpty():
                raise ValueError(f"recorded_at {recorded_at} lies before an earlier merge")
        near = old.filter(F.col(BUCKET).isin([r[0] for r in fresh.select(BUCKET).distinct().collect()]))
        now = near.filter("recorded_to IS NULL").join(fresh.select(*keys).distinct(), keys, "left_semi")
        points = now.select(*keys, *values, "valid_from", F.lit(0).alias("new")).unionByName(fresh.select(*keys, *values, "valid_from", F.lit(1).alias("new")))
        points = points.groupBy(*keys, "valid_from").agg(F.max_by(F.struct(*values), "new").alias("v")).select(*keys, "v.*", "valid_from")
        line = points.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy(*keys).orderBy("valid_from")))
        both = now.select(*keys, *values, "valid_from", "valid_to", "recorded_from").unionByName(line.withColumn("recorded_from", F.lit(None).cast("timestamp")).withColumn("next", F.lit(True)), allowMissingColumns=True)
        states = both.groupBy(*keys, *values, "valid_from", "valid_to").agg(F.max("recorded_from").alias("recorded_from"), F.coalesce(F.max("next"), F.lit(False)).alias("next"))
        moved = states.filter(was.isNull() | ~F.col("next")).withColumn(BUCKET, self._bucket())
        moved = materialize(moved.withColumn("closed", was.isNotNull()), "moved")
        buckets = sorted(r[0] for r in moved.select(BUCKET).distinct().collect())
        if not buckets:
            return []
        # What a merge of the same time had opened was never seen, and goes.
        closed = moved.filter(F.col("closed") & (was < at)).withColumn("recorded_to", at)
        opened = moved.filter("NOT closed").withColumn("recorded_from", at).withColumn("recorded_to", F.lit(None).cast("timestamp"))
        same = [*keys, *values, "valid_from", "valid_to"]
        gone = moved.filter("closed").select(*[F.col(c).alias(f"gone_{k}") for k, c in enumerate(same)])
        match = F.col("recorded_to").isNull()
        for k, c in enumerate(same):
            match = match & F.col(c).eqNullSafe(F.col(f"gone_{k}"))
        stay = near.filter(F.col(BUCKET).isin(buckets)).join(gone, match, "left_anti")
        columns = [*same, "recorded_from", "recorded_to", BUCKET]
        merged = stay.select(columns).unionByName(closed.select(columns)).unionByName(opened.select(columns))
        # Written apart first: the buckets that are replaced are read for it.
        merged = materialize(merged, "merged")
        merged.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        return buckets
