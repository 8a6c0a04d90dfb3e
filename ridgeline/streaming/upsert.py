"""Exactly-once upserts of a stream into a keyed table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch
from ..sources.versions import VersionedTable


def latest(keys: list[str], order: list[str]) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """Keep the row of largest ``order`` of each key; a new row wins a tie with
    an old one only by its other columns."""

    def combine(old: DataFrame | None, new: DataFrame) -> DataFrame:
        both = old.unionByName(new) if old is not None else new
        rest = [c for c in both.columns if c not in keys and c not in order]
        # One aggregate with partial sums: a key of many rows is reduced in the tasks that read it.
        top = both.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("top"))
        return top.select(*keys, "top.*").select(*both.columns)

    return combine


def upsert_batches(table: VersionedTable, order: list[str], writer: str) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: the table keeps the latest row of each
    key.  Spark runs a batch again, under the same number, if it ended without
    a checkpoint; the table's log knows the number and leaves it out.  Rows with
    a null key are dropped.  ``writer`` names the stream and its checkpoint."""
    combine = latest(table.keys, order)

    def run(rows: DataFrame, batch: int) -> None:
        keyed = rows.dropna(subset=table.keys)
        # Kept, as it is read for the list of buckets and for the merge; what is lost is read again.
        kept = combine(None, keyed).persist()
        try:
            table.merge(kept, combine, writer, batch)
        finally:
            kept.unpersist()

    return run


def upsert_stream(spark: SparkSession, stream: DataFrame, keys: list[str], order: list[str], path: str | None = None, buckets: int = 16) -> DataFrame:
    """Run a stream over what its source holds into a keyed table and read it;
    a call with the path of an earlier one goes on where that ended."""
    path = path or scratch.new_path(spark, "upserted")
    table = VersionedTable(spark, path, keys, buckets)
    query = stream.writeStream.foreachBatch(upsert_batches(table, order, "stream")).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    found = table.read()
    return found if found is not None else spark.createDataFrame([], stream.schema)
