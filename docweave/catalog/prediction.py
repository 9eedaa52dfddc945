"""Predictions, batches, confidence and the document run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.catalog.analytics import felt, summary_sql, typed
from docweave.catalog.extraction import ALL_PATTERNS
from docweave.catalog.registry import query, with_tables
from docweave.catalog.textprep import CONTENT, TRIMMED, documents
from docweave.operators import confidence as conf
from docweave.operators.skew import with_position
from docweave.plans import predict, process
from docweave.plans.store import RunStore
from docweave.session import scratch
from docweave.sources import derived
from docweave.sources.tables import load

SOURCES = ["invoices", "emails", "docs"]
BASE = with_tables(texts=SOURCES)
E = f"e AS (SELECT document_id, count(*) AS n, avg(confidence) AS c FROM ({ALL_PATTERNS}) GROUP BY 1)"
SCORED = f"""{BASE}, {E}, p AS (SELECT t.document_id, t.kind, t.document_type, t.type_confidence, e.n, e.c, s.label, s.score
FROM ({typed()}) t LEFT JOIN e USING (document_id) JOIN (SELECT document_id, label, score FROM ({felt()})) s USING (document_id)),
o AS (SELECT *, (type_confidence + coalesce(c, 0) + score) / (2 + (c IS NOT NULL)::INTEGER) AS overall FROM p)"""


def _texts(spark: SparkSession, base: str) -> DataFrame:
    return derived.texts(spark, base, SOURCES)


@query(
    "extract_and_predict",
    f"""{SCORED} SELECT o.document_id, document_type, coalesce(n, 0)::BIGINT AS entities, label, score,
len({CONTENT})::INTEGER AS processed_tokens, round(overall, 9) AS overall_confidence, 'document_type_prediction,entity_extraction,nlp_analysis,sentiment_analysis' AS steps FROM o JOIN texts USING (document_id)""",
)
def extract_and_predict(spark: SparkSession, base: str) -> DataFrame:
    return predict.extract_and_predict(_texts(spark, base)).select(
        "document_id",
        "document_type_prediction.document_type",
        F.col("entity_count").alias("entities"),
        "nlp_analysis.processed_tokens",
        "sentiment.label",
        "sentiment.score",
        F.round("overall_confidence", 9).alias("overall_confidence"),
        F.array_join("processing_steps", ",").alias("steps"),
    )


@query(
    "agg_overall_confidence",
    f"{SCORED} SELECT document_id, round(overall, 9) AS overall_confidence FROM o",
)
def agg_overall_confidence(spark: SparkSession, base: str) -> DataFrame:
    return predict.extract_and_predict(_texts(spark, base)).select(
        "document_id", F.round("overall_confidence", 9).alias("overall_confidence")
    )


@query(
    "filter_high_confidence",
    f"""{SCORED}, r AS (SELECT document_id, round(overall, 9) AS overall_confidence FROM o)
SELECT document_id, overall_confidence, overall_confidence >= 0.8 AS high_confidence,
CASE WHEN overall_confidence < 0.8 THEN 'Low confidence' END AS filtered_reason FROM r""",
)
def filter_high_confidence(spark: SparkSession, base: str) -> DataFrame:
    """Predictions of all texts; low ones are marked, not dropped."""
    done = predict.extract_and_predict(_texts(spark, base))
    return conf.label_confidence(done, F.round("overall_confidence", 9)).select(
        "document_id", "overall_confidence", "high_confidence", "filtered_reason"
    )


@query(
    "project_options",
    f"""{BASE} SELECT document_id, document_type, type_confidence AS confidence, round(type_confidence, 9) AS overall_confidence FROM ({typed()})""",
)
def project_options(spark: SparkSession, base: str) -> DataFrame:
    """Entities and sentiment switched off: neither is in the plan."""
    out = predict.extract_and_predict(_texts(spark, base), include_entities=False, include_sentiment=False)
    return out.select(
        "document_id",
        "document_type_prediction.document_type",
        "document_type_prediction.confidence",
        F.round("overall_confidence", 9).alias("overall_confidence"),
    )


@query(
    "predict_document_type",
    f"""{BASE} SELECT document_id, document_type, type_confidence AS confidence, 'pattern_matching' AS method FROM ({typed()})""",
)
def predict_document_type(spark: SparkSession, base: str) -> DataFrame:
    """An unknown method falls back to the keywords."""
    out = predict.predict_document_type(_texts(spark, base), method="none-such", models={})
    return out.select("document_id", "document_type", "confidence", "method")


@query(
    "process_document_nlp",
    f"""WITH d AS (SELECT doc_id AS document_id, text FROM documents), {summary_sql('d', 'document_id')}
SELECT document_id, length(text)::INTEGER AS original_length, len({CONTENT})::INTEGER AS processed_tokens, document_type,
label, summary, error FROM (SELECT t.*, s.label FROM ({typed('d')}) t JOIN (SELECT document_id, label FROM ({felt('d')})) s USING (document_id)) JOIN summaries USING (document_id)""".replace(
        "JOIN summaries USING", "JOIN (SELECT document_id, summary, error FROM summaries) USING"
    ),
)
def process_document_nlp(spark: SparkSession, base: str) -> DataFrame:
    return predict.process_documents(documents(spark, base)).select(
        "document_id",
        "original_length",
        "processed_tokens",
        "document_type.document_type",
        "sentiment.label",
        "summary",
        "error",
    )


@query(
    "image_predictions",
    f"""WITH d AS (SELECT doc_id AS document_id, text FROM documents)
SELECT document_id, length({TRIMMED}) > 10 AS success, CASE WHEN length({TRIMMED}) > 10 THEN document_type END AS document_type,
CASE WHEN length({TRIMMED}) <= 10 THEN 'Insufficient text extracted for predictions' END AS warning FROM ({typed('d')})""",
)
def image_predictions(spark: SparkSession, base: str) -> DataFrame:
    return predict.process_image_texts(documents(spark, base)).select(
        "document_id", "success", "prediction.document_type", "warning"
    )


# --- batches ----------------------------------------------------------------------------------


def positions(spark: SparkSession, base: str, width: int = 1_000_000) -> DataFrame:
    """Turns of all conversations in order. Pieces: conversations by the million, the conversation, its turns by the million."""
    turns = load(spark, base, "conversations").select("conv_id", "turn", "role", "text")
    pieces = [F.floor(F.col("conv_id") / width), F.col("conv_id"), F.floor(F.col("turn") / width)]
    return with_position(turns, ["turn"], pieces)


POSITION = "SELECT conv_id, turn, role, text, row_number() OVER (ORDER BY conv_id, turn) - 1 AS position FROM conversations"


@query("win_batch_index", f"SELECT conv_id, turn, position AS batch_index FROM ({POSITION})")
def win_batch_index(spark: SparkSession, base: str) -> DataFrame:
    return positions(spark, base).select("conv_id", "turn", F.col("position").alias("batch_index"))


@query(
    "win_batch_ids",
    f"SELECT conv_id, turn, position // 10 + 1 AS batch_id, position % 10 + 1 AS item_id FROM ({POSITION})",
)
def win_batch_ids(spark: SparkSession, base: str) -> DataFrame:
    batch, item = conf.batch_numbers(F.col("position"))
    return positions(spark, base).select("conv_id", "turn", batch.alias("batch_id"), item.alias("item_id"))


@query(
    "agg_batch_status",
    f"""SELECT batch_id, count(*) AS total_processed, count(*) FILTER (WHERE length(text) >= 100) AS succeeded,
count(*) FILTER (WHERE length(text) < 100) AS failed FROM (SELECT position // 10 + 1 AS batch_id, text FROM ({POSITION})) GROUP BY batch_id""",
)
def agg_batch_status(spark: SparkSession, base: str) -> DataFrame:
    batch, _ = conf.batch_numbers(F.col("position"))
    error = F.when(F.length("text") < 100, "too short")
    return conf.batch_status(positions(spark, base).withColumn("batch_id", batch), error)


@query(
    "union_batches",
    f"""WITH b AS (SELECT *, position // 10 + 1 AS batch_id FROM ({POSITION}))
SELECT conv_id, turn, batch_id, upper(role) AS result, NULL AS error FROM b WHERE length(text) >= 100
UNION ALL SELECT conv_id, turn, batch_id, NULL, 'too short' FROM b WHERE length(text) < 100""",
)
def union_batches(spark: SparkSession, base: str) -> DataFrame:
    """Good and failed items of the batches in one table."""
    batch, _ = conf.batch_numbers(F.col("position"))
    items = positions(spark, base).withColumn("batch_id", batch)
    good = items.where(F.length("text") >= 100).select("conv_id", "turn", "batch_id", F.upper("role").alias("result"))
    failed = items.where(F.length("text") < 100).select("conv_id", "turn", "batch_id", F.lit("too short").alias("error"))
    return good.unionByName(failed, allowMissingColumns=True)


@query(
    "agg_security_audit",
    """SELECT user_id, count(*) AS checks, count(*) FILTER (WHERE event_type = 'error') AS failed_checks,
count(*) FILTER (WHERE event_type <> 'error' AND value > 10) AS warnings,
CASE WHEN bool_or(event_type = 'error') THEN 'failed' ELSE 'passed' END AS overall_status FROM events GROUP BY user_id""",
)
def agg_security_audit(spark: SparkSession, base: str) -> DataFrame:
    """Data-quality checks of every user's events, rolled up."""
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("value") > 10, "warning").otherwise("passed")
    return conf.audit_status(load(spark, base, "events").withColumn("status", status), ["user_id"])


# --- the document run -------------------------------------------------------------------------

PATHED = """SELECT doc_id AS document_id, text,
 concat('in/', cast(doc_id as string), case doc_id % 4 when 0 then '.txt' when 1 then '.pdf' when 2 then '.PNG' else '.exe' end) AS path,
 n_chars * case when doc_id % 50 = 0 then 5000 else 1 end AS size FROM {documents}"""


def incoming(spark: SparkSession, base: str) -> DataFrame:
    return spark.sql(PATHED, documents=derived.source(spark, base, "documents"))


RUN = f"""WITH d AS ({PATHED.format(documents='documents')}),
texts AS (SELECT document_id, 'document' AS kind, text FROM d),
e AS (SELECT document_id, count(*) AS n FROM ({ALL_PATTERNS}) GROUP BY 1),
g AS (SELECT t.*, e.n, s.label, size > 16777216 AS large, document_id % 4 = 3 AS odd, length({TRIMMED}) < 10 AS brief, coalesce(text, '') = '' AS empty
  FROM ({typed('d')}) t LEFT JOIN e USING (document_id) JOIN (SELECT document_id, label FROM ({felt('d')})) s USING (document_id))
SELECT document_id, NOT (large OR odd OR brief OR empty) AS success,
CASE WHEN large THEN 1 WHEN odd THEN 2 ELSE 11 - brief::INTEGER - 3 * empty::INTEGER END AS steps_completed,
CASE WHEN large THEN 2 WHEN odd THEN 3 ELSE 11 END AS total_steps,
CASE WHEN large OR odd THEN 0 ELSE length(text) END::INTEGER AS extracted_text_length,
CASE WHEN large OR odd OR empty THEN 'unknown' ELSE document_type END AS document_type,
CASE WHEN large OR odd OR empty THEN 0.0 ELSE type_confidence END::DOUBLE AS confidence,
CASE WHEN large OR odd OR empty THEN 0 ELSE coalesce(n, 0) END::INTEGER AS entities_found,
CASE WHEN large OR odd OR empty THEN 'unknown' ELSE label END AS sentiment,
CASE WHEN large THEN 'File too large' WHEN odd THEN 'Unsupported file type: .exe' WHEN brief THEN 'Insufficient text for analysis' END AS first_error FROM g"""


@query("document_run", RUN)
def document_run(spark: SparkSession, base: str) -> DataFrame:
    """All eleven steps over the corpus, stored; what the store tells of each document. A second run adds nothing."""
    store = RunStore(spark, scratch(spark, "runs"))
    for _ in range(2):
        store.run(incoming(spark, base), "first")
    return store.read("summary").drop("run")


@query(
    "step_registry",
    f"""SELECT document_id, CASE WHEN size > 16777216 THEN 2 ELSE 3 END AS steps_run,
NOT (size > 16777216 OR document_id % 4 = 3) AS success FROM ({PATHED.format(documents='documents')})""",
)
def step_registry(spark: SparkSession, base: str) -> DataFrame:
    """A caller's own list of steps: the three gates alone."""
    out = process.run(incoming(spark, base), process.REGISTRY[:3])
    return out.select("document_id", F.size("processing_log").alias("steps_run"), "success")
