"""Step logs: durations, gates, summaries.

``logs(document_id, step, success, duration, timestamp)`` has one row per step of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

# The steps in order, and those that end the run when they fail.
STEPS = [
    "initialization",
    "security_check",
    "file_validation",
    "ocr_processing",
    "text_analysis",
    "entity_extraction",
    "document_classification",
    "sentiment_analysis",
    "storage_operation",
    "database_storage",
    "cleanup",
]
CRITICAL = ["initialization", "file_validation", "security_check"]


def step_order() -> Column:
    """Position of a step in ``STEPS`` (from 1, 0 if unknown)."""
    return F.array_position(F.array(*[F.lit(s) for s in STEPS]), F.col("step"))


def step_durations(logs: DataFrame) -> DataFrame:
    """Step number, seconds since the previous step and since the first of the document."""
    by_time = W.Window.partitionBy("document_id").orderBy("timestamp", "step")
    micros = F.unix_micros("timestamp")
    return logs.select(
        "document_id",
        "step",
        F.row_number().over(by_time).alias("step_no"),
        ((micros - F.lag(micros).over(by_time)) / 1e6).alias("since_previous"),
        ((micros - F.first(micros).over(by_time)) / 1e6).alias("since_start"),
    )


def gate(logs: DataFrame) -> DataFrame:
    """Steps that run: everything up to and including the first failed critical step."""
    stop = F.min(
        F.when(F.col("step").isin(*CRITICAL) & ~F.col("success"), step_order())
    ).over(W.Window.partitionBy("document_id"))
    return (
        logs.withColumn("_stop", stop)
        .where(F.col("_stop").isNull() | (step_order() <= F.col("_stop")))
        .drop("_stop")
    )


def summary(logs: DataFrame) -> DataFrame:
    """Steps completed and run, total time and outcome per document."""
    return logs.groupBy("document_id").agg(
        F.bool_and("success").alias("success"),
        F.count_if("success").alias("steps_completed"),
        F.count("*").alias("total_steps"),
        F.sum("duration").alias("processing_time"),
        F.when(F.bool_and("success"), F.lit(None).cast("string"))
        .otherwise("Processing failed")
        .alias("error"),
    )
