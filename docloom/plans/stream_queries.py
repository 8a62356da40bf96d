"""Queries that run as streams over events to their end, each equal to its batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.streaming import misses, runs

STAMP = "yyyy-MM-dd HH:mm:ss"


def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Events and their values by hour and type: a watermark, updates as they come."""
    out = runs.run_to_end(runs.windowed(runs.events_stream(spark, sf)), "update", ["start", "event_type"])
    return out.select(F.date_format("start", STAMP).alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of each user, ended by half an hour without an event."""
    out = runs.run_to_end(runs.sessions(runs.events_stream(spark, sf)), "complete")
    return out.select("user_id", F.date_format("start", STAMP).alias("start"), "n")


def stream_hourly_limit(spark: SparkSession, sf: str) -> DataFrame:
    """Error events as misses, at most one an hour for each user: kept in state."""
    errors = runs.events_stream(spark, sf).where("event_type = 'error'")
    logged = errors.selectExpr("cast(user_id AS string) AS query_hash", "'no_results' AS error_type", "cast(null AS string) AS source_type_filter", "date_trunc('SECOND', ts) AS detected_at")
    out = runs.run_to_end(misses.hourly_stream(logged), "append")
    return out.select("query_hash", F.date_format("detected_at", STAMP).alias("detected_at"))


QUERIES = {"stream_windows": stream_windows, "stream_sessions": stream_sessions, "stream_hourly_limit": stream_hourly_limit}
ORACLES = {
    "stream_windows": """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total
FROM events GROUP BY ALL""",
    "stream_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS cut
  FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, s""",
    "stream_hourly_limit": """WITH RECURSIVE e AS (SELECT DISTINCT user_id, date_trunc('second', ts) AS t FROM events WHERE event_type = 'error'),
k AS (SELECT user_id, min(t) AS t FROM e GROUP BY user_id
  UNION ALL SELECT k.user_id, (SELECT min(e.t) FROM e WHERE e.user_id = k.user_id AND e.t >= k.t + INTERVAL 1 HOUR) FROM k WHERE k.t IS NOT NULL)
SELECT user_id::VARCHAR AS query_hash, strftime(t, '%Y-%m-%d %H:%M:%S') AS detected_at FROM k WHERE t IS NOT NULL""",
}
