"""The eleven-step document pipeline as one lazy plan.

``files(document_id, path, size, text)`` goes in; a struct per step, the log and the errors come out.
Steps are plain ``DataFrame -> DataFrame`` functions in a list that callers may change. Once a
critical step has failed, every later step's expressions sit behind the gate and are not evaluated.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import classify, files, text as prep
from docweave.functions.entities import pattern_entities
from docweave.functions.fields import document_fields
from docweave.operators.logs import CRITICAL, STEPS

Step = tuple[str, Callable[[DataFrame], DataFrame]]


def _outcome(error: Column, **fields: Column) -> Column:
    """Struct of a step: success, error and, on success, its fields."""
    parts = [F.when(error.isNull(), v).alias(k) for k, v in fields.items()]
    return F.struct(error.isNull().alias("success"), error.cast("string").alias("error"), *parts)


def _put(df: DataFrame, step: str, outcome: Column) -> DataFrame:
    """Add the step behind the gate, and close the gate if a critical step fails."""
    out = df.withColumn(step, F.when(F.col("_open"), outcome))
    if step in CRITICAL:
        out = out.withColumn("_open", F.col("_open") & F.coalesce(F.col(f"{step}.success"), F.lit(False)))
    return out


def initialization(df: DataFrame) -> DataFrame:
    error = F.when(F.coalesce(F.col("document_id").cast("string"), F.lit("")) == "", "No document ID provided")
    return _put(df, "initialization", _outcome(error))


def security_check(df: DataFrame) -> DataFrame:
    return _put(df, "security_check", _outcome(files.size_error(F.col("size")), file_size=F.col("size")))


def file_validation(df: DataFrame) -> DataFrame:
    path = F.col("path")
    return _put(
        df,
        "file_validation",
        _outcome(files.type_error(path), file_type=F.lower(files.extension(path)), file_size=F.col("size")),
    )


def ocr_processing(df: DataFrame) -> DataFrame:
    """Texts are given here; images and PDF bytes reach this table through the OCR operators."""
    confidence = F.col("text_confidence") if "text_confidence" in df.columns else F.lit(1.0)
    return _put(
        df,
        "ocr_processing",
        _outcome(
            F.lit(None).cast("string"),
            text=F.coalesce("text", F.lit("")),
            method=files.read_method(F.col("path")),
            confidence=confidence,
        ),
    )


def text_analysis(df: DataFrame) -> DataFrame:
    body = F.col("ocr_processing.text")
    error = F.when(~prep.enough_for_nlp(body), "Insufficient text for analysis")
    return _put(
        df,
        "text_analysis",
        _outcome(
            error,
            text_length=F.length(body),
            processed_tokens=F.size(prep.preprocess(body)),
            document_type=classify.document_type(body),
        ),
    )


def entity_extraction(df: DataFrame) -> DataFrame:
    body = F.col("ocr_processing.text")
    kind = F.coalesce("text_analysis.document_type.document_type", F.lit("general"))
    error = F.when(~prep.present(body), "No text available for entity extraction")
    return _put(
        df,
        "entity_extraction",
        _outcome(
            error,
            document_type=kind,
            patterns=pattern_entities(body),
            document_specific=document_fields(kind, body),
        ),
    )


def document_classification(df: DataFrame) -> DataFrame:
    body = F.col("ocr_processing.text")
    error = F.when(~prep.present(body), "No text available for classification")
    return _put(
        df, "document_classification", _outcome(error, classification=classify.document_type(body))
    )


def sentiment_analysis(df: DataFrame) -> DataFrame:
    body = F.col("ocr_processing.text")
    error = F.when(~prep.present(body), "No text available for sentiment analysis")
    return _put(df, "sentiment_analysis", _outcome(error, sentiment=classify.sentiment(body)))


def storage_operation(df: DataFrame) -> DataFrame:
    path = files.storage_path(F.col("document_id").cast("string"), F.col("path"))
    return _put(df, "storage_operation", _outcome(F.lit(None).cast("string"), storage_path=path))


def database_storage(df: DataFrame) -> DataFrame:
    kind = F.coalesce("document_classification.classification.document_type", F.lit("unknown"))
    conf = F.coalesce("document_classification.classification.confidence", F.lit(0.0))
    return _put(
        df,
        "database_storage",
        _outcome(F.lit(None).cast("string"), document_type=kind, confidence_score=conf),
    )


def cleanup(df: DataFrame) -> DataFrame:
    return _put(df, "cleanup", _outcome(F.lit(None).cast("string")))


REGISTRY: list[Step] = [
    ("initialization", initialization),
    ("security_check", security_check),
    ("file_validation", file_validation),
    ("ocr_processing", ocr_processing),
    ("text_analysis", text_analysis),
    ("entity_extraction", entity_extraction),
    ("document_classification", document_classification),
    ("sentiment_analysis", sentiment_analysis),
    ("storage_operation", storage_operation),
    ("database_storage", database_storage),
    ("cleanup", cleanup),
]
assert [name for name, _ in REGISTRY] == STEPS


def start(documents: DataFrame) -> DataFrame:
    """Documents before the first step: the gate is open."""
    return documents.withColumn("_open", F.lit(True))


def finish(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Documents after the steps ``names``, with ``processing_log``, ``errors`` and ``success``."""
    logged = [
        F.struct(
            F.lit(name).alias("step"),
            F.col(f"{name}.success").alias("success"),
            F.col(f"{name}.error").alias("error"),
        )
        for name in names
    ]
    ran = F.filter(F.array(*logged), lambda s: s["success"].isNotNull())
    return (
        df.drop("_open")
        .withColumn("processing_log", ran)
        .withColumn("errors", F.filter("processing_log", lambda s: ~s["success"]))
        .withColumn("success", F.size("errors") == 0)
    )


def run(documents: DataFrame, steps: Sequence[Step] = REGISTRY) -> DataFrame:
    """All steps in one lazy plan; ``plans.store`` keeps what they give."""
    df = start(documents)
    for _, step in steps:
        df = df.transform(step)
    return finish(df, [name for name, _ in steps])


def summarize(processed: DataFrame) -> DataFrame:
    """One line per document: outcome, steps, length, type, confidence, entities, sentiment."""
    return processed.select(
        "document_id",
        "success",
        F.size(F.filter("processing_log", lambda s: s["success"])).alias("steps_completed"),
        F.size("processing_log").alias("total_steps"),
        F.coalesce(F.length("ocr_processing.text"), F.lit(0)).alias("extracted_text_length"),
        F.coalesce("document_classification.classification.document_type", F.lit("unknown")).alias("document_type"),
        F.coalesce("document_classification.classification.confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce(F.size("entity_extraction.patterns"), F.lit(0)).alias("entities_found"),
        F.coalesce("sentiment_analysis.sentiment.label", F.lit("unknown")).alias("sentiment"),
        F.get("errors", F.lit(0))["error"].alias("first_error"),
    )
