from datetime import date, datetime

import pytest
from helpers import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ridgeline.session import table
from ridgeline.sources.sketches import HLL_ERROR, KLL_ERROR, THETA_ERROR, DailySketches


@pytest.fixture(scope="module")
def events(spark):
    user = F.pmod(F.xxhash64(F.col("id") % 90_000), F.lit(60_000))
    return spark.range(300_000).select(
        F.timestamp_seconds(1704067200 + (F.col("id") * 7919) % (86_400 * 10)).alias("ts"), user.alias("user_id"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("kind"), (F.pmod(F.xxhash64("id"), F.lit(10_000)) / 7).alias("value"),
    ).persist()


def files(folder):
    return {str(f.relative_to(folder)) for f in folder.rglob("*.parquet")}


def test_ranges_stay_within_the_stated_errors(spark, events, tmp_path):
    sketches = DailySketches(spark, f"file://{tmp_path}/s", ["kind"])
    sketches.refresh(events)
    for first, last in ((date(2024, 1, 1), date(2024, 1, 10)), (date(2024, 1, 3), date(2024, 1, 5))):
        inside = events.filter(F.to_date("ts").between(F.lit(str(first)).cast("date"), F.lit(str(last)).cast("date")))
        for r in sketches.summary(sketches.days(first, last), ["kind"], (0.1, 0.5, 0.9)).collect():
            own = inside.filter(F.col("kind") == r.kind)
            n, users, *below = own.agg(F.count(F.lit(1)), F.count_distinct("user_id"), *[F.count_if(F.col("value") <= v) for v in (r.p10, r.p50, r.p90)]).first()
            assert r.n == n and abs(r.who - users) <= HLL_ERROR * users and abs(r.who_theta - users) <= THETA_ERROR * users
            assert all(abs(b / n - rank) <= KLL_ERROR for b, rank in zip(below, (0.1, 0.5, 0.9)))
    early, late = sketches.days(date(2024, 1, 1), date(2024, 1, 3)), sketches.days(date(2024, 1, 6), date(2024, 1, 9))
    users = [events.filter(F.to_date("ts").between(F.lit(a).cast("date"), F.lit(b).cast("date"))).select("kind", "user_id").distinct() for a, b in (("2024-01-01", "2024-01-03"), ("2024-01-06", "2024-01-09"))]
    both = {r.kind: r["count"] for r in users[0].join(users[1], ["kind", "user_id"]).groupBy("kind").count().collect()}
    most = max(r["count"] for u in users for r in u.groupBy("kind").count().collect())
    got = {r.kind: r.returned for r in sketches.returned(early, late, ["kind"]).collect()}
    assert set(got) == set(both) and all(abs(got[k] - both[k]) <= THETA_ERROR * most for k in both)


def test_a_day_is_made_anew_alone(spark, events, tmp_path):
    sketches = DailySketches(spark, f"file://{tmp_path}/s", ["kind"])
    sketches.refresh(events)
    before = files(tmp_path)
    sketches.refresh(events.filter("to_date(ts) = DATE '2024-01-04' AND kind = 'a'"))
    after = files(tmp_path)
    assert before ^ after and all("day=2024-01-04" in f for f in before ^ after)
    day = date(2024, 1, 4)
    assert [r.kind for r in sketches.summary(sketches.days(day, day), ["kind"]).collect()] == ["a"]
    plan = sketches.days(day, day)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_nulls_and_few_events_are_exact(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [(at, 1, "a", 1.0), (at, 1, "a", None), (at, None, "a", 2.0), (None, 5, "a", 2.0), (at, 7, None, None)]
    sketches = DailySketches(spark, f"file://{tmp_path}/s", ["kind"])
    sketches.refresh(spark.createDataFrame(rows, "ts timestamp_ntz, user_id long, kind string, value double"))
    got = {r.kind: tuple(r)[1:] for r in sketches.summary(spark.read.parquet(sketches.path), ["kind"]).collect()}
    assert got == {"a": (3, 1, 1, 1.0, 2.0), None: (1, 1, 1, None, None)}


def test_weekly_query_equals_counts(spark):
    events = table(spark, SMALL, "events")
    week = F.date_trunc("week", F.to_date("ts")).cast("date").alias("week")
    exact = {(r.week, r.event_type): (r.n, r.who) for r in events.groupBy(week, "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("who")).collect()}
    # Few users: both sketches hold them all.
    assert {(r.week, r.event_type): (r.n, r.who_theta) for r in entry.queries()["weekly_sketches"](spark, SMALL).collect()} == exact
