"""Queries over events and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money, url_host
from ..operators.asof import asof_join
from ..operators.interval import interval_join
from ..session import table
from ..sources import scratch
from ..sources.sketches import DailySketches
from ..streaming import run_to_end, windowed_counts
from ..streaming.patterns import Steps, closed_sequences
from ..streaming.upsert import upsert_stream


def event_property_totals(spark: SparkSession, root: str) -> DataFrame:
    """Events and values by the number in their JSON properties."""
    events = table(spark, root, "events").select(F.get_json_object("props", "$.k").cast("int").alias("k"), "value")
    return events.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum(money("value")).cast("double").alias("total"))


def daily_counts(spark: SparkSession, root: str) -> DataFrame:
    """Events by day and type."""
    return windowed_counts(table(spark, root, "events"))


def daily_counts_stream(spark: SparkSession, root: str) -> DataFrame:
    """The same as a stream in append mode: the days that its watermark closes."""
    # A pattern, as a stream's plain path must be a folder.
    source = spark.readStream.schema(table(spark, root, "events").schema).parquet(f"{root}/event[s].parquet")
    return run_to_end(spark, windowed_counts(source), "daily-counts")


def user_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Sessions of a user: runs of events less than six hours apart."""
    events = table(spark, root, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    sessions = events.groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    return sessions.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("first_ts"), F.col("last").cast("timestamp_ntz").alias("last_ts"), "n")


def last_click_before_purchase(spark: SparkSession, root: str) -> DataFrame:
    """For each purchase, the user's latest click up to it."""
    events = table(spark, root, "events")
    buys = events.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    clicks = events.filter("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts"))
    return asof_join(buys, clicks, "user_id", "ts", ["click_ts", "click_id"]).select("event_id", "click_id", "click_ts")


def errors_near_purchases(spark: SparkSession, root: str) -> DataFrame:
    """Errors of anyone within five minutes before or after a purchase."""
    events = table(spark, root, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")))
    errors = events.filter("event_type = 'error'").select(F.col("event_id").alias("error_id"), F.col("s").alias("at"))
    buys = events.filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), F.col("s").alias("mid"))
    span = 300_000_000
    return interval_join(errors, buys, F.col("at"), F.col("mid") - span, F.col("mid") + span, 2 * span).select("error_id", "purchase_id")


def pages_by_host(spark: SparkSession, root: str) -> DataFrame:
    """Pages by host of their URL."""
    return table(spark, root, "pages").groupBy(url_host("url").alias("host")).agg(F.count(F.lit(1)).alias("pages"))


def view_click_purchase_stream(spark: SparkSession, root: str) -> DataFrame:
    """Purchases within a day of a view that a click lies between, of those that the stream's
    watermark closes."""
    source = spark.readStream.schema(table(spark, root, "events").schema).parquet(f"{root}/event[s].parquet")
    found = closed_sequences(spark, source, Steps(seconds=86_400))
    times = [F.timestamp_micros(c).cast("timestamp_ntz").alias(n) for c, n in (("first", "view_ts"), ("last", "purchase_ts"))]
    return found.select(F.col("key").alias("user_id"), *[F.col("ids")[k].alias(n) for k, n in enumerate(("view_id", "click_id", "purchase_id"))], *times)


def latest_events_stream(spark: SparkSession, root: str) -> DataFrame:
    """Each user's latest event of each type, kept up by a stream of upserts."""
    source = spark.readStream.schema(table(spark, root, "events").schema).parquet(f"{root}/event[s].parquet")
    return upsert_stream(spark, source.select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"])


def weekly_sketches(spark: SparkSession, root: str) -> DataFrame:
    """Events, estimated users and quantiles of values by week and type, merged
    from sketches of days."""
    sketches = DailySketches(spark, scratch.new_path(spark, "sketches"), ["event_type"])
    sketches.refresh(table(spark, root, "events"))
    week = F.date_trunc("week", "day").cast("date").alias("week")
    return sketches.summary(spark.read.parquet(sketches.path), [week, "event_type"])


QUERIES = (event_property_totals, daily_counts, daily_counts_stream, user_sessions, last_click_before_purchase, errors_near_purchases, pages_by_host, view_click_purchase_stream, latest_events_stream, weekly_sketches)

#: ``weekly_sketches`` are estimates and have no SQL.
_DAILY = "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2"

SQL = {
    "event_property_totals": """
SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total FROM events GROUP BY 1""",
    "daily_counts": _DAILY,
    "daily_counts_stream": f"SELECT * FROM ({_DAILY}) WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
    "user_sessions": """
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM (
  SELECT user_id, ts, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
    SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR, true) AS fresh FROM events))
GROUP BY user_id, s""",
    "last_click_before_purchase": """
SELECT b.event_id, c.event_id AS click_id, c.ts AS click_ts FROM (SELECT * FROM events WHERE event_type = 'purchase') b
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON b.user_id = c.user_id AND b.ts >= c.ts""",
    "errors_near_purchases": """
SELECT e.event_id AS error_id, p.event_id AS purchase_id FROM events e JOIN events p
ON e.ts >= p.ts - INTERVAL 5 MINUTE AND e.ts < p.ts + INTERVAL 5 MINUTE WHERE e.event_type = 'error' AND p.event_type = 'purchase'""",
    "view_click_purchase_stream": """
WITH e AS (
  SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER before AS view_id,
    last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER before AS click_id FROM events
  WINDOW before AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT p.user_id, c.view_id, p.click_id, p.event_id AS purchase_id, v.ts AS view_ts, p.ts AS purchase_ts
FROM e p JOIN e c ON c.event_id = p.click_id JOIN e v ON v.event_id = c.view_id
WHERE p.event_type = 'purchase' AND p.ts - v.ts <= INTERVAL 1 DAY AND p.ts <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events WHERE event_type IN ('view', 'click', 'purchase'))""",
    "latest_events_stream": "SELECT user_id, event_type, ts, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "pages_by_host": "SELECT lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, count(*) AS pages FROM pages GROUP BY 1",
}
