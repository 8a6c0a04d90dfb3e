"""Range join: points that fall into intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interval_join(points: DataFrame, intervals: DataFrame, at: Column, begin: Column, end: Column, width: int) -> DataFrame:
    """Rows of ``points`` and ``intervals`` with begin <= at < end.

    ``at``, ``begin`` and ``end`` are whole numbers.  Both sides are joined on
    buckets of ``width``: an interval is repeated for each bucket that it
    touches, so the width should be near the usual length of an interval.  The
    column names of the two sides must differ.
    """
    spread = F.sequence(F.floor(begin / width), F.floor((end - 1) / width))
    many = intervals.filter(end > begin).withColumn("bucket_", F.explode(spread))
    return points.withColumn("bucket_", F.floor(at / width)).join(many, "bucket_").filter((at >= begin) & (at < end)).drop("bucket_")
