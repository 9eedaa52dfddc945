"""Recognised text: pages, engines, words and annotations put back together.

``pages(document_id, page, engine, text, confidence)`` is the common input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Engines in the order that breaks ties, and the fallback threshold.
ENGINES = ["tesseract", "google_vision"]
FALLBACK_THRESHOLD = 0.5


def number_pages(df: DataFrame, pages: Column) -> DataFrame:
    """Array of page texts to rows; the first page is 1."""
    return df.select("document_id", F.posexplode(pages).alias("i", "text")).select(
        "document_id", (F.col("i") + 1).alias("page"), "text"
    )


def join_pages(pages: DataFrame) -> DataFrame:
    """One text per document: non-empty pages joined by line ends.

    The confidences of the non-empty pages are divided by the number of *all* pages.
    """
    filled = F.coalesce(F.col("text") != "", F.lit(False))
    parts = F.sort_array(F.collect_list(F.when(filled, F.struct("page", "text"))))
    return pages.groupBy("document_id").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"),
        (F.sum(F.when(filled, F.coalesce("confidence", F.lit(0.0))).otherwise(0.0)) / F.count("*")).alias(
            "confidence"
        ),
        F.count("*").alias("pages"),
    )


def word_confidence(confidences: Column) -> Column:
    """Mean of the word confidences above zero, 0.0 if there is none."""
    kept = F.filter(confidences, lambda c: c > 0)
    total = F.aggregate(kept, F.lit(0.0), lambda acc, c: acc + c)
    return F.when(F.size(kept) > 0, total / F.size(kept)).otherwise(0.0)


def annotation_confidence(confidences: Column) -> Column:
    """Mean without the first annotation (the whole page); NULLs do not count."""
    rest = F.filter(F.slice(confidences, F.lit(2), F.greatest(F.size(confidences) - 1, F.lit(0))), lambda c: c.isNotNull())
    total = F.aggregate(rest, F.lit(0.0), lambda acc, c: acc + c)
    return (
        F.when(F.size(confidences) <= 1, 1.0)
        .when(F.size(rest) > 0, total / F.size(rest))
        .otherwise(0.0)
    )


def block_text(words: Column) -> Column:
    """Words given as arrays of symbols, to the text of their block."""
    return F.array_join(F.transform(words, lambda symbols: F.array_join(symbols, "")), " ")


def _rank() -> Column:
    """Earlier engines win ties."""
    chain = F.lit(-len(ENGINES))
    for i, name in enumerate(ENGINES):
        chain = F.when(F.col("engine") == name, F.lit(-i)).otherwise(chain)
    return chain


def best_engine(pages: DataFrame, normalise: bool = False) -> DataFrame:
    """Per page the result with the highest confidence.

    One engine reports 0-100, the other 0-1; ``normalise`` brings them to one scale, the default
    compares them as they are.
    """
    conf = F.coalesce("confidence", F.lit(0.0))
    if normalise:
        conf = F.when(F.col("engine") == "tesseract", conf / 100.0).otherwise(conf)
    best = F.max_by(F.struct("engine", "text", "confidence"), F.struct(conf, _rank()))
    return pages.groupBy("document_id", "page").agg(best.alias("b")).select("document_id", "page", "b.*")


def fallback_engine(pages: DataFrame, threshold: float = FALLBACK_THRESHOLD) -> DataFrame:
    """Per page the second engine if it is sure enough, else the first."""

    def of(engine: str) -> Column:
        return F.max(
            F.when(F.col("engine") == engine, F.struct("engine", "text", "confidence"))
        )

    both = pages.groupBy("document_id", "page").agg(
        of("google_vision").alias("v"), of("tesseract").alias("t")
    )
    chosen = F.when(F.col("v.confidence") > threshold, F.col("v")).otherwise(F.col("t"))
    return both.select("document_id", "page", chosen.alias("c")).select("document_id", "page", "c.*")
