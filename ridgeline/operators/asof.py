"""As-of join: for each row, the latest earlier row of the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], bucket_seconds: int = 86_400) -> DataFrame:
    """``left`` with ``values`` of the latest row of ``right`` of equal ``key``
    and no later ``time``; null where there is none.

    A key's rows are dealt over time buckets, so that a frequent key is many
    groups; the last row of each bucket is then carried into later ones.  Times
    must be timestamps; on a tie the row of ``right`` counts as earlier, and of
    several such rows the one of largest values.
    """
    bucket = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / (bucket_seconds * 1_000_000))
    packed = F.struct(*values)
    a = left.select(F.col(key), F.col(time), F.lit(1).alias("side"), F.lit(None).cast(right.select(packed.alias("p")).schema["p"].dataType).alias("seen"), F.struct(*left.columns).alias("row"))
    b = right.select(F.col(key), F.col(time), F.lit(0).alias("side"), packed.alias("seen"), F.lit(None).cast(a.schema["row"].dataType).alias("row"))
    both = a.unionByName(b).withColumn("bucket", bucket)
    lasts = both.filter("side = 0").groupBy(key, "bucket").agg(F.max(F.struct(F.col(time), F.col("seen"))).alias("end"))
    before = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = both.select(key, "bucket").distinct().join(lasts, [key, "bucket"], "left").withColumn("carried", F.last(F.col("end.seen"), ignorenulls=True).over(before))
    inside = Window.partitionBy(key, "bucket").orderBy(F.col(time), F.col("side"), F.col("seen")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("own", F.last("seen", ignorenulls=True).over(inside)).filter("side = 1")
    joined = found.join(starts.select(key, "bucket", "carried"), [key, "bucket"])
    return joined.select("row.*", F.coalesce("own", "carried").alias("seen")).select(*left.columns, *[F.col(f"seen.{v}").alias(v) for v in values])
