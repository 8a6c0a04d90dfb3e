"""Sketches of events by day, stored once and merged for any range of days.

A day's row for each group holds the number of events, a HyperLogLog and a theta
sketch of who made them, and a KLL sketch of their values.  Sketches of days
merge into that of the range, so a range costs a row for each day and group
instead of its events; a day is made anew without reading the others.

Stated errors, at three standard deviations or 99 %: HLL of 2^12 registers 3.9 %,
theta of 2^12 entries 4.7 % of the larger side (exact below 4,096), KLL of k = 200
2.7 % in rank.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LG_HLL, LG_THETA, K_KLL = 12, 12, 200
HLL_ERROR, THETA_ERROR, KLL_ERROR = 0.039, 0.047, 0.027


class DailySketches:
    """The sketches in ``path``, by day and ``group`` columns."""

    def __init__(self, spark: SparkSession, path: str, group: list[str]):
        self.spark, self.path, self.group = spark, path, group

    def refresh(self, events: DataFrame, *, time: str = "ts", who: str = "user_id", value: str = "value") -> None:
        """Make the days of ``events`` anew, each from all its events; other
        days keep their files.  Rows without a time are dropped; a null who or
        value counts as an event alone, a null group is a group."""
        rows = events.select(F.to_date(time).alias("day"), *self.group, F.col(who).alias("who_"), F.col(value).cast("double").alias("value_")).filter("day IS NOT NULL")
        made = rows.groupBy("day", *self.group).agg(
            F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("who_", LG_HLL).alias("who_hll"), F.theta_sketch_agg("who_", LG_THETA).alias("who_theta"), F.kll_sketch_agg_double("value_", K_KLL).alias("values_kll"),
        )
        made.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.path)

    def days(self, first: date, last: date) -> DataFrame:
        """Rows of the days of a range, both ends included."""
        return self.spark.read.parquet(self.path).filter(F.col("day").between(F.lit(first.isoformat()).cast("date"), F.lit(last.isoformat()).cast("date")))

    def merged(self, rows: DataFrame, by: list[str | Column]) -> DataFrame:
        """One row for each value of ``by``: n, who_hll, who_theta, values_kll."""
        return rows.groupBy(*by).agg(
            F.sum("n").alias("n"), F.hll_union_agg("who_hll").alias("who_hll"), F.theta_union_agg("who_theta", LG_THETA).alias("who_theta"), F.kll_merge_agg_double("values_kll", K_KLL).alias("values_kll"),
        )

    def summary(self, rows: DataFrame, by: list[str | Column], ranks: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
        """``by``, n, who (distinct, by HLL), who_theta, and a column p<rank>
        for each of ``ranks``; null where a group has no value."""
        found = self.merged(rows, by)
        names = [c for c in found.columns if c not in ("n", "who_hll", "who_theta", "values_kll")]
        some = F.kll_sketch_get_n_double("values_kll") > 0
        quantiles = [F.when(some, F.kll_sketch_get_quantile_double("values_kll", F.lit(r))).alias(f"p{round(100 * r)}") for r in ranks]
        return found.select(*names, "n", F.hll_sketch_estimate("who_hll").alias("who"), F.round(F.theta_sketch_estimate("who_theta")).cast("long").alias("who_theta"), *quantiles)

    def returned(self, before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
        """``by`` and how many of those in ``before`` are in ``after`` too, by
        intersection of theta sketches; groups of both sides."""
        left, right = (self.merged(rows, by).select(*by, F.col("who_theta").alias(name)) for rows, name in ((before, "a"), (after, "b")))
        return left.join(right, by).select(*by, F.round(F.theta_sketch_estimate(F.theta_intersection("a", "b"))).cast("long").alias("returned"))

