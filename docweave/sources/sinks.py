"""The stored tables: rows as they are kept, and the writers.

Ids are digests of what identifies a row, so a job that is run again writes the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.files import basename, extension, results_path

STATUSES = ["pending", "processing", "completed", "failed"]


def row_id(*parts: Column) -> Column:
    """Digest of the parts; a missing part differs from an empty one, and a bar inside from one between."""
    marked = [F.coalesce(F.replace(p.cast("string"), F.lit("|"), F.lit("||")), F.lit("|-")) for p in parts]
    return F.sha2(F.concat_ws("|", *marked), 256)


def write_table(
    df: DataFrame,
    target: str,
    fmt: str = "parquet",
    mode: str = "append",
    partition_by: Sequence[str] = (),
    **options: str,
) -> None:
    """Write to any connector Spark knows (``jdbc``, ``org.apache.spark.sql.cassandra``, files)."""
    writer = df.write.format(fmt).mode(mode).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "jdbc":
        writer.option("dbtable", target).save()
    else:
        writer.save(target)


def document_rows(df: DataFrame, created_at: Column, keep: Sequence[str] = ()) -> DataFrame:
    """``documents``: ``df(path, file_size, document_type, confidence_score, extracted_text)``, and ``keep``."""
    return df.select(
        *keep,
        row_id(F.col("path")).alias("id"),
        basename(F.col("path")).alias("filename"),
        F.lower(extension(F.col("path"))).alias("file_type"),
        F.col("file_size").cast("int").alias("file_size"),
        F.lit("pending").alias("processing_status"),
        "document_type",
        "confidence_score",
        "extracted_text",
        created_at.alias("created_at"),
    )


def with_status(df: DataFrame, status: Column) -> DataFrame:
    """Set the processing status; anything outside the four states becomes NULL."""
    return df.withColumn("processing_status", F.when(status.isin(*STATUSES), status))


def entity_rows(df: DataFrame) -> DataFrame:
    """``entities``: type falls back to the label; missing numbers are 0, a missing method unknown."""

    def get(name: str, default=None) -> Column:
        col = F.col(name) if name in df.columns else F.lit(None)
        return col if default is None else F.coalesce(col, F.lit(default))

    kind = F.coalesce(get("type"), get("label")).cast("string")
    start, end = get("start", 0).cast("int"), get("end", 0).cast("int")
    method = get("method", "unknown")
    return df.select(
        row_id(F.col("document_id"), kind, F.col("text"), method, start, end).alias("id"),
        "document_id",
        kind.alias("entity_type"),
        F.col("text").alias("entity_text"),
        get("confidence", 0.0).cast("double").alias("confidence_score"),
        start.alias("start_position"),
        end.alias("end_position"),
        method.alias("extraction_method"),
    )


def prediction_rows(df: DataFrame, model: str, kind: str, payload: Sequence[str]) -> DataFrame:
    """``predictions``: class, confidence and the rest as JSON."""
    return df.select(
        row_id(F.col("document_id"), F.lit(model), F.lit(kind)).alias("id"),
        "document_id",
        F.lit(model).alias("model_name"),
        F.lit(kind).alias("prediction_type"),
        "predicted_class",
        F.col("confidence").alias("confidence_score"),
        F.to_json(F.struct(*payload)).alias("prediction_data"),
    )


def log_rows(logs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``processing_logs``: one row per step, and the columns ``keep``."""
    return logs.select(
        *keep,
        row_id(F.col("document_id"), F.col("step"), F.col("timestamp")).alias("id"),
        "document_id",
        F.col("step").alias("processing_step"),
        F.when(F.col("success"), "completed").otherwise("failed").alias("status"),
        F.when(~F.col("success"), F.concat(F.col("step"), F.lit(" failed"))).alias("error_message"),
        F.col("duration").alias("processing_time"),
        F.col("timestamp").alias("created_at"),
    )


def content_rows(df: DataFrame, metadata: Column) -> DataFrame:
    """``document_content``: bytes, text and a real map of metadata."""
    return df.select(
        "document_id",
        "filename",
        "content_type",
        F.encode("text", "utf-8").alias("raw_content"),
        F.col("text").alias("extracted_text"),
        F.coalesce(metadata, F.create_map().cast("map<string,string>")).alias("processing_metadata"),
    )


def analysis_rows(df: DataFrame, kind: str, payload: Sequence[str], confidence: Column) -> DataFrame:
    """``document_analysis``: the result as JSON, confidence 0.0 where there is none."""
    return df.select(
        "document_id",
        F.lit(kind).alias("analysis_type"),
        row_id(F.col("document_id"), F.lit(kind)).alias("analysis_id"),
        F.to_json(F.struct(*payload)).alias("results"),
        F.coalesce(confidence, F.lit(0.0)).alias("confidence_score"),
    )


def entity_store_rows(entities: DataFrame) -> DataFrame:
    """``entity_store``: positions as a map."""
    return entities.select(
        "document_id",
        "entity_type",
        row_id(F.col("document_id"), F.col("entity_type"), F.col("start"), F.col("end"), F.col("method")).alias("entity_id"),
        F.col("text").alias("entity_text"),
        F.col("confidence").alias("confidence_score"),
        F.create_map(F.lit("start"), F.col("start"), F.lit("end"), F.col("end")).alias("position_data"),
        F.col("method").alias("extraction_method"),
    )


def write_results_json(df: DataFrame, path: str, buckets: int = 64) -> None:
    """One JSON line per document below ``processed``, spread over a fixed number of folders."""
    bucket = F.pmod(F.xxhash64("document_id"), F.lit(buckets)).alias("bucket")
    named = df.select(
        "document_id",
        results_path(F.col("document_id").cast("string")).alias("results_path"),
        F.to_json(F.struct(*[c for c in df.columns])).alias("results"),
        bucket,
    )
    named.write.mode("overwrite").partitionBy("bucket").json(path)


def store_both(writes: dict[str, tuple[DataFrame, str]]) -> dict[str, str | None]:
    """Several stores of one result; a store that fails does not stop the others.

    Returns the error per store, None where the write went through.
    """
    outcome: dict[str, str | None] = {}
    for name, (df, path) in writes.items():
        try:
            write_table(df, path, mode="overwrite")
            outcome[name] = None
        except Exception as error:  # the outcome is reported, not raised
            outcome[name] = str(error)
    return outcome
