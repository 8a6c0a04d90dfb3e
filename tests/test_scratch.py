from ridgeline.sources import scratch


def test_tables_go_by_session(spark):
    other = f"{scratch.shared_dir(spark)}/ridgeline/another-session/table"
    spark.range(3).write.parquet(other)
    kept = scratch.materialize(spark.range(5), "numbers")
    path = kept.inputFiles()[0].rsplit("/", 1)[0]
    assert kept.count() == 5 and scratch.folders(spark, path.rsplit("/", 1)[0])
    scratch.drop_scratch(spark)
    assert not scratch.folders(spark, path.rsplit("/", 1)[0]) and spark.read.parquet(other).count() == 3
    assert scratch.materialize(spark.range(2), "again").count() == 2
