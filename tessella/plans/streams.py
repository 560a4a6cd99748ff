"""Queries that run as streams over given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.streaming import sessions

from .registry import query, table

#: A row far behind all others, which closes what is still open.
CLOCK = {"user_id": -1, "event_type": "clock", "value": 0.0}


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """All events as a stream of files in the order of their time."""
    from datetime import datetime

    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    return sessions.written_stream(spark, e, "ts", 4, CLOCK | {"event_id": -1, "ts": datetime(2100, 1, 1)})[0]


@query("stream_sessions", """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 4 HOUR THEN 0 ELSE 1 END AS new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, epoch_us(min(ts))::BIGINT AS start_us, epoch_us(max(ts))::BIGINT AS end_us, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, s""")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of a user's events with at most four hours between them, closed by timers."""
    got = sessions.drained(sessions.sessions(_events(spark, sf), "user_id", "ts", "value", 4 * 3600, "1 hour"))
    return got.where("key <> '-1'").select(F.col("key").cast("bigint").alias("user_id"), F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n", F.round("total", 4).alias("total"))


@query("stream_join", """
SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase' AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 6 HOUR""")
def stream_join(spark: SparkSession, sf: str) -> DataFrame:
    """Views and the purchases of the same user within six hours, joined as streams."""
    e = _events(spark, sf)
    views = e.where(F.col("event_type").isin("view", "clock")).select(F.col("event_id").alias("view_id"), F.col("user_id").alias("viewer"), F.col("ts").alias("viewed"))
    bought = e.where(F.col("event_type").isin("purchase", "clock")).select(F.col("event_id").alias("purchase_id"), F.col("user_id").alias("buyer"), F.col("ts").alias("bought"))
    got = sessions.drained(sessions.joined(views, bought, ("viewer", "buyer"), ("viewed", "bought"), "6 HOURS", "1 hour"))
    return got.where("view_id >= 0").select("view_id", "purchase_id")
