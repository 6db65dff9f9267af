"""Audit-event dashboards: events stand for audit events, users for sessions.

Every query takes its "now" from NOW, so that results don't depend on the clock. Paths are event_type/k, with k from
the JSON properties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from claimlens.functions.columns import url_host
from claimlens.operators.spines import zero_filled
from claimlens.sources.tables import table

#: The dashboards' "now": the first instant after the tables' last event.
NOW = "TIMESTAMP_NTZ'2024-01-31 00:00:00'"
#: First and last day of the zero-filled calendar.
FROM_DAY, TO_DAY = "2024-01-01", "2024-01-31"


def since(span: str) -> Column:
    return F.col("ts") >= F.expr(NOW) - F.expr(f"INTERVAL {span}")


def path() -> Column:
    return F.concat_ws("/", "event_type", F.get_json_object("props", "$.k"))


def audit_kpi_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, views, errors and distinct sessions over all time, the last day, and the last half hour, in one pass."""
    return table(spark, sf_dir, "events").agg(
        F.count("*").alias("n_events"),
        F.count_if(F.col("event_type") == "view").alias("n_views"),
        F.count_if(F.col("event_type") == "error").alias("n_errors"),
        F.count_if(since("1 DAY")).alias("n_last_day"),
        F.countDistinct("user_id").alias("n_sessions"),
        F.countDistinct(F.when(since("1 DAY"), F.col("user_id"))).alias("n_sessions_last_day"),
        F.countDistinct(F.when(since("30 MINUTES"), F.col("user_id"))).alias("n_active_sessions"),
    )


def audit_visits_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").where("event_type = 'view'").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("visits"))
    spine = spark.sql(f"SELECT explode(sequence(DATE'{FROM_DAY}', DATE'{TO_DAY}')) AS day")
    return zero_filled(spine, days, "day", ["visits"])


def audit_unique_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sessions of each day: two aggregations, so that a hot day's sessions are counted in parts."""
    pairs = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "user_id").where("user_id is not null").distinct()
    return pairs.groupBy("day").agg(F.count("*").alias("unique_sessions"))


def audit_hour_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = table(spark, sf_dir, "events").groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    return zero_filled(spark.sql("SELECT explode(sequence(0, 23)) AS hour"), hours, "hour", ["n"])


def audit_weekday_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sunday is 0."""
    days = table(spark, sf_dir, "events").groupBy((F.dayofweek("ts") - 1).alias("weekday")).agg(F.count("*").alias("n"))
    return zero_filled(spark.sql("SELECT explode(sequence(0, 6)) AS weekday"), days, "weekday", ["n"])


def audit_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy((F.dayofweek("ts") - 1).alias("weekday"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))


def audit_auth_split_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of each day with and without a known user, with the day's distinct sessions: one conditional aggregation."""
    known = F.col("user_id") % 3 != 0
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.count_if(known).alias("authenticated"), F.count_if(~known).alias("anonymous"), F.countDistinct("user_id").alias("sessions")
    )


def audit_top_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(path().alias("path")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(10)


def audit_top_referrers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent hosts of all pages, own hosts left out."""
    host = table(spark, sf_dir, "pages").select(url_host(F.col("url")).alias("host")).where(~F.col("host").contains("localhost") & ~F.col("host").contains("example.org"))
    return host.groupBy("host").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(5)


def audit_recent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 sessions that were seen last, with their newest event, all their events, and the user's name."""
    newest = F.max(F.struct("ts", "event_id", "event_type"))
    sessions = table(spark, sf_dir, "events").groupBy("user_id").agg(newest.alias("x"), F.count("*").alias("n_events"))
    sessions = sessions.orderBy(F.desc("x.ts"), F.desc("x.event_id")).limit(15).select("user_id", F.col("x.event_type").alias("last_page"), F.col("x.ts").alias("last_seen"), "n_events")
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"))
    return sessions.join(names, "user_id", "left").select("user_id", "user_name", "last_page", "last_seen", "n_events")


def filtered_events(events: DataFrame, event_type: str | None = None, user_id: int | None = None, start: str | None = None, end: str | None = None, contains: str | None = None) -> DataFrame:
    """events with only the filters that are given; bounds of time are inclusive, null paths don't contain anything."""
    if event_type is not None:
        events = events.where(F.col("event_type") == event_type)
    if user_id is not None:
        events = events.where(F.col("user_id") == user_id)
    if start is not None:
        events = events.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        events = events.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    if contains is not None:
        events = events.where(F.coalesce(path().contains(contains), F.lit(False)))
    return events


def page_of(df: DataFrame, order: list[Column], page: int, size: int, most: int = 100) -> DataFrame:
    """A page: min(size, most) rows, behind (page - 1) * size rows: the clamp holds for the rows, not for the offset."""
    return df.orderBy(*order).offset((page - 1) * size).limit(min(size, most))


def audit_filtered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filtered_events(table(spark, sf_dir, "events"), event_type="click", start="2024-01-05", end="2024-01-25", contains="click/4")
    return page_of(rows, [F.desc("ts"), F.desc("event_id")], 2, 40).select("event_id", "ts", "user_id", path().alias("path"))


def retention_delete(events: DataFrame, days: int = 90, now: str = NOW) -> DataFrame:
    """What a retention of so many days keeps."""
    return events.where(F.col("ts") >= F.expr(now) - F.expr(f"INTERVAL {days} DAYS"))


def audit_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = retention_delete(table(spark, sf_dir, "events"), 20)
    return kept.groupBy("event_type").agg(F.count("*").alias("kept"), F.min("ts").alias("oldest"))


def rate_limited_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed windows of six hours and two events a user in each, two more wait, others are refused."""
    start = F.window("ts", "6 hours").start
    place = F.row_number().over(W.partitionBy("user_id", "bucket").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", start.cast("timestamp_ntz").alias("bucket")).withColumn("place", place)
    fate = F.when(F.col("place") <= 2, "allowed").when(F.col("place") <= 4, "queued").otherwise("rejected")
    return rows.select("event_id", "user_id", "bucket", fate.alias("fate"))


QUERIES = {
    f.__name__: f
    for f in (
        audit_kpi_strip, audit_visits_per_day, audit_unique_per_day, audit_hour_zero_filled, audit_weekday_zero_filled, audit_heatmap, audit_auth_split_per_day,
        audit_top_paths, audit_top_referrers, audit_recent_sessions, audit_filtered_page, audit_retention, rate_limited_events,
    )
}

_PATH = "event_type || '/' || json_extract_string(props, '$.k')"

ORACLES = {
    "audit_kpi_strip": """
        SELECT count(*) AS n_events, count(*) FILTER (event_type = 'view') AS n_views, count(*) FILTER (event_type = 'error') AS n_errors,
               count(*) FILTER (ts >= TIMESTAMP '2024-01-30 00:00:00') AS n_last_day, count(DISTINCT user_id) AS n_sessions,
               count(DISTINCT user_id) FILTER (ts >= TIMESTAMP '2024-01-30 00:00:00') AS n_sessions_last_day,
               count(DISTINCT user_id) FILTER (ts >= TIMESTAMP '2024-01-30 23:30:00') AS n_active_sessions
        FROM events""",
    "audit_visits_per_day": f"""
        SELECT d::DATE AS day, count(e.ts) AS visits
        FROM generate_series(DATE '{FROM_DAY}', DATE '{TO_DAY}', INTERVAL 1 DAY) AS s(d)
        LEFT JOIN events e ON e.ts::DATE = d::DATE AND e.event_type = 'view' GROUP BY 1""",
    "audit_unique_per_day": "SELECT ts::DATE AS day, count(DISTINCT user_id) AS unique_sessions FROM events WHERE user_id IS NOT NULL GROUP BY 1",
    "audit_hour_zero_filled": "SELECT h::INT AS hour, count(e.ts) AS n FROM range(0, 24) AS s(h) LEFT JOIN events e ON hour(e.ts) = h GROUP BY 1",
    "audit_weekday_zero_filled": "SELECT w::INT AS weekday, count(e.ts) AS n FROM range(0, 7) AS s(w) LEFT JOIN events e ON dayofweek(e.ts) = w GROUP BY 1",
    "audit_heatmap": "SELECT dayofweek(ts)::INT AS weekday, hour(ts)::INT AS hour, count(*) AS n FROM events GROUP BY 1, 2",
    "audit_auth_split_per_day": """
        SELECT ts::DATE AS day, count(*) FILTER (user_id % 3 <> 0) AS authenticated, count(*) FILTER (user_id % 3 = 0) AS anonymous,
               count(DISTINCT user_id) AS sessions FROM events GROUP BY 1""",
    "audit_top_paths": f"SELECT {_PATH} AS path, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, path LIMIT 10",
    "audit_top_referrers": """
        WITH h AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages)
        SELECT host, count(*) AS n FROM h WHERE host NOT LIKE '%localhost%' AND host NOT LIKE '%example.org%' GROUP BY 1 ORDER BY n DESC, host LIMIT 5""",
    "audit_recent_sessions": """
        WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n_events FROM events),
             t AS (SELECT user_id, event_type AS last_page, ts AS last_seen, n_events FROM n WHERE r = 1 ORDER BY ts DESC, event_id DESC LIMIT 15)
        SELECT user_id, c_name AS user_name, last_page, last_seen, n_events FROM t LEFT JOIN customer ON c_custkey = user_id""",
    "audit_filtered_page": f"""
        SELECT event_id, ts, user_id, {_PATH} AS path FROM events
        WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25' AND contains({_PATH}, 'click/4')
        ORDER BY ts DESC, event_id DESC LIMIT 40 OFFSET 40""",
    "audit_retention": "SELECT event_type, count(*) AS kept, min(ts) AS oldest FROM events WHERE ts >= TIMESTAMP '2024-01-11' GROUP BY 1",
    "rate_limited_events": """
        WITH r AS (SELECT event_id, user_id, time_bucket(INTERVAL 6 HOUR, ts) AS bucket, ts FROM events),
             p AS (SELECT *, row_number() OVER (PARTITION BY user_id, bucket ORDER BY ts, event_id) AS place FROM r)
        SELECT event_id, user_id, bucket, CASE WHEN place <= 2 THEN 'allowed' WHEN place <= 4 THEN 'queued' ELSE 'rejected' END AS fate FROM p""",
}
