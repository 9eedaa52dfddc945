"""Overall confidence of a prediction and the filter on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: predictions below it are set apart.
THRESHOLD = 0.8


def overall_confidence(type_conf: Column, entity_conf: Column, sentiment_score: Column) -> Column:
    """Unweighted mean of the parts that are present (not NULL), 0.0 if none is."""
    parts = F.array_compact(F.array(type_conf, entity_conf, sentiment_score))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(parts) > 0, total / F.size(parts)).otherwise(0.0)


def label_confidence(df: DataFrame, confidence: Column, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``overall_confidence``, ``high_confidence`` and ``filtered_reason``; no row is dropped."""
    return df.withColumns({"overall_confidence": confidence}).withColumns(
        {
            "high_confidence": F.col("overall_confidence") >= threshold,
            "filtered_reason": F.when(F.col("overall_confidence") < threshold, "Low confidence"),
        }
    )


def high_confidence(labelled: DataFrame) -> DataFrame:
    return labelled.where("high_confidence")


def batch_numbers(position: Column, size: int = 10) -> tuple[Column, Column]:
    """``batch_id`` and ``item_id`` of a zero-based position; both start at 1."""
    return (F.floor(position / size) + 1).cast("bigint"), (F.pmod(position, F.lit(size)) + 1).cast("bigint")


def batch_status(df: DataFrame, error: Column) -> DataFrame:
    """Items, successes and failures per batch."""
    return df.groupBy("batch_id").agg(
        F.count("*").alias("total_processed"),
        F.count_if(error.isNull()).alias("succeeded"),
        F.count_if(error.isNotNull()).alias("failed"),
    )


def audit_status(checks: DataFrame, by: list[str]) -> DataFrame:
    """Checks rolled up: failed as soon as one failed; warnings pass."""
    return checks.groupBy(*by).agg(
        F.count("*").alias("checks"),
        F.count_if(F.col("status") == "failed").alias("failed_checks"),
        F.count_if(F.col("status") == "warning").alias("warnings"),
        F.when(F.max(F.col("status") == "failed"), "failed").otherwise("passed").alias("overall_status"),
    )
