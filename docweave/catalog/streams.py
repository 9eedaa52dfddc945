"""Structured Streaming jobs run over the given tables until they are drained."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.catalog.events import LIMITED, SESSIONS, STATUS, WINDOWS
from docweave.catalog.registry import query
from docweave.functions.classify import document_type
from docweave.operators.entities import extract
from docweave.session import scratch
from docweave.streaming import jobs, limiter


def table_stream(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A table as a stream; the pattern fits a single file as well as a folder of parts."""
    schema = spark.read.parquet(f"{base}/{name}.parquet").schema
    return jobs.read_stream(spark, f"{base}/{name}.parque[t]", schema)


@query(
    "stream_ingest",
    """SELECT doc_id AS document_id, n_chars, length(text)::INTEGER AS text_length FROM documents""",
)
def stream_ingest(spark: SparkSession, base: str) -> DataFrame:
    """Documents as they arrive, typed and stored to two tables per micro-batch."""
    target = scratch(spark, "ingest")
    stream = table_stream(spark, base, "documents").withColumnRenamed("doc_id", "document_id")

    def transform(df: DataFrame) -> DataFrame:
        return df.withColumn("t", document_type(F.col("text")))

    stored = {
        "documents": lambda df: df.select(
            "document_id", "n_chars", F.length("text").alias("text_length"), "t.document_type"
        ),
        "entities": extract,
    }
    jobs.ingest(stream, transform, stored, target, scratch(spark, "ingest-state")).awaitTermination()
    return spark.read.parquet(f"{target}/documents").select("document_id", "n_chars", "text_length")


@query("stream_rate_limit", LIMITED)
def stream_rate_limit(spark: SparkSession, base: str) -> DataFrame:
    events = table_stream(spark, base, "events").select("event_id", F.col("user_id").alias("client_id"), "ts")
    return limiter.limit_stream(events, seconds=86_400, limit=3).select("event_id", "client_id", "admitted")


@query("stream_rate_windows_live", WINDOWS)
def stream_rate_windows_live(spark: SparkSession, base: str) -> DataFrame:
    """All windows, as after the last batch."""
    events = table_stream(spark, base, "events").select(F.col("user_id").alias("client_id"), "ts")
    return jobs.rate_windows(events).select("client_id", F.unix_micros("start").alias("start_us"), "requests")


@query("stream_sessions_live", f"SELECT client_id, start_us, end_us + 3600000000 AS end_us, events FROM ({SESSIONS})")
def stream_sessions_live(spark: SparkSession, base: str) -> DataFrame:
    """All sessions; they end one pause after their last event."""
    events = table_stream(spark, base, "events").select(F.col("user_id").alias("client_id"), "ts")
    return jobs.sessions(events).select(
        "client_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events"
    )


@query("stream_status_live", STATUS)
def stream_status_live(spark: SparkSession, base: str) -> DataFrame:
    """Last status of every document, by the changes' own time, not their arrival."""
    changes = table_stream(spark, base, "events").select(
        F.col("user_id").alias("document_id"), F.col("event_type").alias("status"), "ts", "event_id"
    )
    return jobs.latest_status(changes).select("document_id", "status", F.unix_micros("updated_at").alias("updated_us"))
