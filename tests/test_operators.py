from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ridgeline.operators.asof import asof_join
from ridgeline.operators.interval import interval_join
from ridgeline.sources import files
from ridgeline.streaming import run_to_end, windowed_counts

START = datetime(2024, 1, 1)


def test_asof_carries_over_empty_buckets_and_ties(spark):
    hour = timedelta(hours=1)
    left = spark.createDataFrame([(1, START + 100 * hour), (1, START), (2, START), (1, START + 5 * hour)], "k int, ts timestamp")
    right = spark.createDataFrame([(1, START + 5 * hour, 5), (1, START + 2 * hour, 2), (3, START, 9)], "k int, ts timestamp, v int")
    got = {(r.k, r.ts): r.v for r in asof_join(left, right, "k", "ts", ["v"], 3600).collect()}
    assert got == {(1, START + 100 * hour): 5, (1, START): None, (2, START): None, (1, START + 5 * hour): 5}


def test_asof_of_empty_sides(spark):
    left = spark.createDataFrame([(1, START)], "k int, ts timestamp")
    right = spark.createDataFrame([], "k int, ts timestamp, v int")
    assert [r.v for r in asof_join(left, right, "k", "ts", ["v"]).collect()] == [None]
    assert asof_join(left.limit(0), right, "k", "ts", ["v"]).count() == 0


def test_interval_join_equals_brute_force(spark):
    points = spark.createDataFrame([(i, (i * 37) % 101) for i in range(60)], "p int, at long")
    spans = spark.createDataFrame([(i, (i * 13) % 90, (i * 13) % 90 + i % 25) for i in range(40)], "s int, b long, e long")
    got = {(r.p, r.s) for r in interval_join(points, spans, F.col("at"), F.col("b"), F.col("e"), 10).collect()}
    assert got == {(p.p, s.s) for p in points.collect() for s in spans.collect() if s.b <= p.at < s.e}


@pytest.mark.parametrize("fmt", files.FORMATS)
def test_files_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a, b"), (2, None), (3, "é\"x")], "id int, t string")
    files.write(df, f"{tmp_path}/out", fmt)
    assert sorted(files.read(spark, f"{tmp_path}/out", fmt, df.schema).collect()) == sorted(df.collect())


def test_partitioned_write_prunes(spark, tmp_path):
    files.write(spark.range(100).withColumn("day", F.col("id") % 5), f"{tmp_path}/out", partition_by=("day",))
    found = files.read(spark, f"{tmp_path}/out").filter("day = 3")
    assert found.count() == 20 and "PartitionFilters: [isnotnull(day" in found._jdf.queryExecution().executedPlan().toString()


def test_unknown_formats_are_refused(spark):
    with pytest.raises(ValueError):
        files.read(spark, "x", "xls")
    with pytest.raises(ValueError):
        files.read(spark, "x", "csv")


def test_stream_drops_late_rows(spark, tmp_path):
    schema = "ts timestamp, event_type string"
    for k, rows in enumerate([[(START, "a"), (START + timedelta(days=3), "a")], [(START + timedelta(days=3), "a")], [(START + timedelta(minutes=1), "a")], [(START + timedelta(days=9), "a")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = {(r.window_start, r.n) for r in run_to_end(spark, windowed_counts(source), "late").collect()}
    # A batch drops what is older than the watermark of the batch before it.
    assert got == {(START, 1), (START + timedelta(days=3), 2)}
