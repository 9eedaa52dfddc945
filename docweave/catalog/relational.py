"""Stored documents and their children."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.catalog.analytics import typed
from docweave.catalog.extraction import found
from docweave.catalog.intake import EXT, listed
from docweave.catalog.registry import query, with_tables
from docweave.catalog.textprep import documents
from docweave.functions import files as fn
from docweave.functions.classify import document_type
from docweave.functions.entities import PATTERNS
from docweave.operators import entities as ents
from docweave.operators import logs as steps
from docweave.operators import relational as rel
from docweave.sources import derived
from docweave.sources.tables import load

DOCS = "d AS (SELECT doc_id AS document_id, lang, text FROM documents)"
CHILD = " UNION ALL ".join(found(n, PATTERNS[n], 0.9, source="d") for n in PATTERNS)
KIDS = f"WITH {DOCS}, kids AS (SELECT document_id, entity_type, text, start_position FROM ({CHILD}))"


def children(spark: SparkSession, base: str) -> DataFrame:
    return ents.extract(documents(spark, base)).select(
        "document_id", "entity_type", "text", F.col("start").alias("start_position")
    )


@query(
    "join_document_entities",
    f"{KIDS} SELECT d.document_id, d.lang, entity_type, kids.text, start_position FROM d LEFT JOIN kids USING (document_id)",
)
def join_document_entities(spark: SparkSession, base: str) -> DataFrame:
    parents = documents(spark, base).select("document_id", "lang")
    return rel.with_children(parents, children(spark, base))


@query(
    "anti_cascade_delete",
    f"{KIDS} SELECT * FROM kids WHERE document_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')",
)
def anti_cascade_delete(spark: SparkSession, base: str) -> DataFrame:
    deleted = documents(spark, base).where("lang = 'en'")
    return rel.delete_cascade(children(spark, base), deleted)


@query(
    "semi_known_documents",
    "SELECT doc_id AS document_id, quality, toxic FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE source <> 'web')",
)
def semi_known_documents(spark: SparkSession, base: str) -> DataFrame:
    known = documents(spark, base).where("source <> 'web'")
    kids = load(spark, base, "labels").withColumnRenamed("doc_id", "document_id")
    return rel.known_children(kids, known)


@query(
    "join_step_results",
    f"""{with_tables('files')}, d AS (SELECT doc_id AS document_id, text FROM documents),
c AS (SELECT document_id, document_type, type_confidence AS confidence FROM ({typed('d')})),
f AS (SELECT CAST(regexp_extract(name, '^documents/([0-9]+)', 1) AS BIGINT) AS document_id, lower({EXT}) AS file_type, size AS file_size
  FROM files WHERE starts_with(name, 'documents/'))
SELECT document_id, coalesce(file_type, 'unknown') AS file_type, coalesce(file_size, 0) AS file_size, coalesce(document_type, 'unknown') AS document_type,
coalesce(confidence, 0.0) AS confidence_score, coalesce(text, '') AS extracted_text FROM d LEFT JOIN c USING (document_id) LEFT JOIN f USING (document_id)""",
)
def join_step_results(spark: SparkSession, base: str) -> DataFrame:
    """One stored row per document; the defaults stand where a step has no result."""
    docs = documents(spark, base)
    types = (
        docs.select("document_id", document_type(F.col("text")).alias("t"))
        .select("document_id", "t.document_type", "t.confidence")
    )
    info = (
        listed(spark, base)
        .where(F.col("name").startswith("documents/"))
        .select(
            fn.stored_id(F.col("name")).cast("bigint").alias("document_id"),
            F.lower(fn.extension(F.col("name"))).alias("file_type"),
            F.col("size").alias("file_size"),
        )
    )
    return rel.document_row(docs, types, info)


@query(
    "join_document_files",
    f"""{with_tables('files')}, n AS (SELECT regexp_extract(name, '^(?:documents|processed)/([0-9]+)', 1) AS document_id, name,
CASE WHEN starts_with(name, 'processed/') THEN 'result' ELSE 'file' END AS kind FROM files)
SELECT d.document_id, name, kind, name IS NOT NULL AS found FROM (SELECT cast(doc_id AS VARCHAR) AS document_id FROM documents) d LEFT JOIN n USING (document_id)""",
)
def join_document_files(spark: SparkSession, base: str) -> DataFrame:
    docs = load(spark, base, "documents").select(F.col("doc_id").cast("string").alias("document_id"))
    return rel.document_files(docs, listed(spark, base))


ASOF = "2024-02-15 00:00:00"


@query(
    "filter_retention",
    f"{with_tables('files')} SELECT name, created_us FROM files WHERE make_timestamp(created_us) < TIMESTAMP '{ASOF}' - INTERVAL 30 DAY",
)
def filter_retention(spark: SparkSession, base: str) -> DataFrame:
    return rel.expired(listed(spark, base), F.lit(ASOF).cast("timestamp"), 30).select("name", "created_us")


@query(
    "agg_status_counts",
    f"""{with_tables('files')} SELECT split_part(name, '/', 1) AS prefix, count(*) AS total,
count(*) FILTER (WHERE make_timestamp(created_us) < TIMESTAMP '{ASOF}' - INTERVAL 30 DAY) AS deleted_count FROM files GROUP BY ALL""",
)
def agg_status_counts(spark: SparkSession, base: str) -> DataFrame:
    """Objects, and those that retention would delete, per prefix."""
    old = F.col("created") < F.lit(ASOF).cast("timestamp") - F.make_dt_interval(F.lit(30))
    return (
        listed(spark, base)
        .groupBy(F.split_part("name", F.lit("/"), F.lit(1)).alias("prefix"))
        .agg(F.count("*").alias("total"), F.count_if(old).alias("deleted_count"))
    )


@query(
    "topk_recent_documents",
    "SELECT o_orderkey AS document_id, o_orderstatus AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100",
)
def topk_recent_documents(spark: SparkSession, base: str) -> DataFrame:
    docs = load(spark, base, "orders").select(
        F.col("o_orderkey").alias("document_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at")
    )
    return rel.recent(docs).drop("created_at")


@query(
    "document_history",
    "SELECT o_orderkey AS document_id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50",
)
def document_history(spark: SparkSession, base: str) -> DataFrame:
    docs = load(spark, base, "orders").select(
        F.col("o_orderkey").alias("document_id"), F.col("o_orderdate").alias("created_at")
    )
    return rel.recent(docs, 50).select("document_id")


@query(
    "win_latest_by_key",
    """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""",
)
def win_latest_by_key(spark: SparkSession, base: str) -> DataFrame:
    events = load(spark, base, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return rel.latest_by_key(events, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


# --- step logs --------------------------------------------------------------------------------

LOGS = with_tables("step_logs")
ORDER = "CASE step " + " ".join(f"WHEN '{s}' THEN {i + 1}" for i, s in enumerate(steps.STEPS)) + " END"


def logs(spark: SparkSession, base: str) -> DataFrame:
    return derived.derive(spark, base, "step_logs")


@query(
    "win_step_durations",
    f"""{LOGS} SELECT document_id, step, row_number() OVER w::INTEGER AS step_no,
(epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER w) / 1e6 AS since_previous,
(epoch_us(timestamp) - first(epoch_us(timestamp)) OVER w) / 1e6 AS since_start FROM step_logs WINDOW w AS (PARTITION BY document_id ORDER BY timestamp, step)""",
)
def win_step_durations(spark: SparkSession, base: str) -> DataFrame:
    return steps.step_durations(logs(spark, base))


@query(
    "critical_step_gate",
    f"""{LOGS}, g AS (SELECT *, min({ORDER}) FILTER (WHERE step IN ('initialization', 'file_validation', 'security_check') AND NOT success) OVER (PARTITION BY document_id) AS stop FROM step_logs)
SELECT document_id, step, success FROM g WHERE stop IS NULL OR {ORDER} <= stop""",
)
def critical_step_gate(spark: SparkSession, base: str) -> DataFrame:
    return steps.gate(logs(spark, base)).select("document_id", "step", "success")


@query(
    "agg_processing_summary",
    f"""{LOGS} SELECT document_id, bool_and(success) AS success, count(*) FILTER (WHERE success) AS steps_completed, count(*) AS total_steps,
round(sum(duration), 6) AS processing_time, CASE WHEN NOT bool_and(success) THEN 'Processing failed' END AS error FROM step_logs GROUP BY document_id""",
)
def agg_processing_summary(spark: SparkSession, base: str) -> DataFrame:
    return steps.summary(logs(spark, base)).withColumn("processing_time", F.round("processing_time", 6))
