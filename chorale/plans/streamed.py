"""Streams drained into tables, against the batch results of SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorale.streaming import streams


def _name(what: str) -> str:
    return f"{what}_{uuid.uuid4().hex[:12]}"


def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    return streams.drained(streams.daily_counts(streams.events(spark, d)), _name("daily"))


def stream_sliding_counts(spark: SparkSession, d: str) -> DataFrame:
    return streams.drained(streams.sliding_counts(streams.events(spark, d)), _name("sliding"))


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions by their size: how many there are of each."""
    s = streams.drained(streams.sessions(streams.events(spark, d)), _name("sessions"))
    return s.groupBy("n").agg(F.count("*").alias("sessions"))


def stream_distinct_events(spark: SparkSession, d: str) -> DataFrame:
    """Events by kind where each is delivered twice and counted once."""
    e = streams.events(spark, d)
    once = streams.drained(streams.distinct_events(e.union(e)), _name("distinct"), mode="append")
    return once.groupBy("event_type").agg(F.count("*").alias("n"))


def stream_follow_ups(spark: SparkSession, d: str) -> DataFrame:
    """Purchases within four hours of a user's views: how many, and after how long."""
    f = streams.drained(streams.followed(streams.events(spark, d), "view", "purchase"), _name("followed"), mode="append")
    return f.groupBy("user_id").agg(F.count("*").alias("n"), F.min("gap").alias("least_gap"), F.sum("gap").alias("gaps"))


_AT = "epoch_us(ts) // 1000000"

ORACLE_SQL = {
    "stream_daily_counts": f"SELECT {_AT} // 86400 * 86400 AS day_start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_sliding_counts": f"WITH e AS (SELECT {_AT} AS t FROM events), s AS (SELECT t, t // 172800 * 172800 AS a FROM e), x AS (SELECT t, a - 172800 * k AS start FROM s, (SELECT unnest([0, 1, 2]) AS k)) SELECT start, count(*) AS n FROM x WHERE t < start + 432000 GROUP BY 1",
    "stream_distinct_events": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "stream_follow_ups": f"""WITH e AS (SELECT user_id, event_type, {_AT} AS t FROM events) SELECT a.user_id, count(*) AS n, min(b.t - a.t) AS least_gap, CAST(sum(b.t - a.t) AS BIGINT) AS gaps
FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.t > a.t AND b.t <= a.t + 14400 GROUP BY 1""",
    "stream_sessions": f"""WITH e AS (SELECT user_id, {_AT} AS t FROM events), c AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) > 7200 THEN 1 ELSE 0 END AS cut FROM e),
s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM c) SELECT n, count(*) AS sessions FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1""",
}
QUERIES = {name: globals()[name] for name in ORACLE_SQL}
