"""Rates, sessions and limits over request events (batch forms)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.catalog.registry import query
from docweave.operators import events as ops
from docweave.operators.relational import latest_by_key
from docweave.sources.derived import requests
from docweave.sources.tables import load

SESSIONS = """SELECT user_id AS client_id, session, min(us) AS start_us, max(us) AS end_us, count(*) AS events FROM (
SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id)::BIGINT AS session FROM (
SELECT event_id, user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 3600000000 THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY ALL"""
# A fold over the requests of a client in time order; only the last three admitted ones matter.
LIMITED = """WITH a AS (SELECT user_id, list_reduce(list_sort(list(epoch_us(ts))),
  lambda acc, x: CASE WHEN len(list_filter(acc[-3:], lambda t: t > x - 86400000000)) < 3 THEN list_append(acc, x) ELSE acc END,
  []::BIGINT[]) AS stamps FROM events GROUP BY user_id)
SELECT event_id, user_id AS client_id, list_contains(stamps, epoch_us(ts)) AS admitted FROM events JOIN a USING (user_id)"""
WINDOWS = """SELECT client_id, start_us, count(*) AS requests FROM (
SELECT user_id AS client_id, (epoch_us(ts) // 10000000 - k) * 10000000 AS start_us FROM events, range(6) r(k)) GROUP BY ALL"""
STATUS = """SELECT user_id AS document_id, arg_max(event_type, struct_pack(a := epoch_us(ts), b := event_id)) AS status,
max(epoch_us(ts)) AS updated_us FROM events GROUP BY user_id"""


@query(
    "win_rate_count",
    """SELECT event_id, user_id AS client_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND 1 PRECEDING) AS recent FROM events""",
)
def win_rate_count(spark: SparkSession, base: str) -> DataFrame:
    return ops.preceding_counts(requests(spark, base)).select("event_id", "client_id", "recent")


@query("stream_session_timeout", SESSIONS)
def stream_session_timeout(spark: SparkSession, base: str) -> DataFrame:
    return ops.gap_sessions(requests(spark, base))


@query("stream_rate_window", WINDOWS)
def stream_rate_window(spark: SparkSession, base: str) -> DataFrame:
    return ops.window_counts(requests(spark, base)).select("client_id", F.unix_micros("start").alias("start_us"), "requests")


@query("stream_status", STATUS)
def stream_status(spark: SparkSession, base: str) -> DataFrame:
    rows = load(spark, base, "events").select(
        F.col("user_id").alias("document_id"), F.col("event_type").alias("status"), "ts", "event_id"
    )
    return latest_by_key(rows, ["document_id"], ["ts", "event_id"]).select(
        "document_id", "status", F.unix_micros("ts").alias("updated_us")
    )


@query("rate_limit_exact", LIMITED)
def rate_limit_exact(spark: SparkSession, base: str) -> DataFrame:
    """Three requests a day: events are sparse, so the window is long."""
    return ops.limit_requests(requests(spark, base), seconds=86_400, limit=3).select("event_id", "client_id", "admitted")
