"""Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by window and event type; works on streams and on tables."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    counts = timed.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def run_to_end(spark: SparkSession, stream: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Run a stream over what its source holds, into Parquet files, and read
    the result.  Offsets and state are kept beside them, in the shared folder
    where no ``path`` is given; a call with the path of an earlier one goes on
    where that ended."""
    path = path or scratch.new_path(spark, label)
    schema = stream.schema
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.schema(schema).parquet(path)
