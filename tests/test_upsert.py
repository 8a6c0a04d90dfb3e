from datetime import datetime, timedelta

import pytest

from ridgeline.sources.versions import Conflict, VersionedTable
from ridgeline.streaming.upsert import latest, upsert_batches, upsert_stream

START = datetime(2024, 1, 1)
SCHEMA = "k long, ts timestamp, v string"


def rows(spark, found):
    return spark.createDataFrame([(k, START + timedelta(hours=h), v) for k, h, v in found], SCHEMA)


def held(df):
    return {r.k: r.v for r in df.collect()}


def files(folder):
    return {f: f.stat().st_mtime_ns for f in folder.rglob("*.parquet")}


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, f"file://{tmp_path}/t", ["k"], buckets=4)


def test_a_batch_that_is_run_again_changes_nothing(spark, table, tmp_path):
    run = upsert_batches(table, ["ts"], "w")
    first, second = rows(spark, [(k, 1, f"a{k}") for k in range(9)] + [(None, 5, "null")]), rows(spark, [(3, 2, "b3"), (4, 0, "old"), (50, 1, "new")])
    run(first, 0)
    run(second, 1)
    wanted = {k: f"a{k}" for k in range(9)} | {3: "b3", 50: "new"}
    before = files(tmp_path)
    assert held(table.read()) == wanted and table.version().number == 2
    for batch, number in ((second, 1), (first, 0), (rows(spark, [(3, 9, "other")]), 1)):
        run(batch, number)
    assert held(table.read()) == wanted and table.version().number == 2
    assert {f: t for f, t in files(tmp_path).items() if "/t/" in str(f)} == {f: t for f, t in before.items() if "/t/" in str(f)}
    run(rows(spark, [(3, 9, "other")]), 2)
    assert held(table.read())[3] == "other" and held(table.read(2)) == wanted


def test_a_failure_before_the_switch_leaves_the_old_version(spark, table, monkeypatch):
    run = upsert_batches(table, ["ts"], "w")
    run(rows(spark, [(1, 1, "a")]), 0)
    with monkeypatch.context() as m:
        m.setattr(table, "_publish", lambda version: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            run(rows(spark, [(1, 2, "b")]), 1)
    assert held(table.read()) == {1: "a"}
    run(rows(spark, [(1, 2, "b")]), 1)
    assert held(table.read()) == {1: "b"}


def test_untouched_buckets_keep_their_files(spark, table):
    run = upsert_batches(table, ["ts"], "w")
    run(rows(spark, [(k, 1, "a") for k in range(40)]), 0)
    before = table.version().folders
    run(rows(spark, [(7, 2, "b")]), 1)
    after = table.version().folders
    assert sum(before[b] != after[b] for b in before) == 1 and len(before) == 4


def test_two_writers(spark, table, monkeypatch):
    combine, publish, raced = latest(["k"], ["ts"]), table._publish, []
    table.merge(rows(spark, [(1, 1, "a")]), combine, "one", 0)

    def late(version):
        if not raced:  # another writer is first
            raced.append(version)
            VersionedTable(spark, table.root, ["k"]).merge(rows(spark, [(2, 1, "b")]), combine, "two", 0)
        publish(version)

    monkeypatch.setattr(table, "_publish", late)
    assert table.merge(rows(spark, [(1, 2, "c")]), combine, "one", 1) == 3
    assert held(table.read()) == {1: "c", 2: "b"} and table.version().batches == {"one": 1, "two": 0}
    with pytest.raises(Conflict):
        publish(raced[0])


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    def stream():
        return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")

    rows(spark, [(1, 1, "a"), (1, 3, "c"), (1, 2, "b")]).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    assert held(upsert_stream(spark, stream(), ["k"], ["ts"], f"file://{tmp_path}/out")) == {1: "c"}
    rows(spark, [(1, 2, "x"), (2, 1, "d")]).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    assert held(upsert_stream(spark, stream(), ["k"], ["ts"], f"file://{tmp_path}/out")) == {1: "c", 2: "d"}


def test_empty_batches(spark, table):
    run = upsert_batches(table, ["ts"], "w")
    run(rows(spark, []), 0)
    assert table.read() is None and table.version().batches == {"w": 0}
    run(rows(spark, [(1, 1, None)]), 1)
    assert held(table.read()) == {1: None}
