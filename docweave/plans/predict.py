"""Text prediction: type, entities, language analysis, sentiment, overall confidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions import classify, text as prep
from docweave.functions.entities import CONFIDENCE, pattern_counts, pattern_entities
from docweave.functions.fields import document_fields
from docweave.functions.regex import let
from docweave.operators.confidence import overall_confidence
from docweave.operators.tfidf import extractive_summary

Scorer = Callable[[DataFrame], DataFrame]


def predict_document_type(df: DataFrame, method: str = "keywords", models: dict[str, Scorer] | None = None) -> DataFrame:
    """Add ``document_type``, ``confidence``, ``method``.

    ``models`` maps names to functions that add ``document_type`` and ``confidence``; a name that is
    not there falls back to the keyword scorer.
    """
    if models and method in models:
        return models[method](df).withColumn("method", F.lit(method))
    best = classify.document_type(F.col("text"))
    return (
        df.withColumn("_t", best)
        .withColumns(
            {
                "document_type": F.col("_t.document_type"),
                "confidence": F.col("_t.confidence"),
                "method": F.col("_t.method"),
            }
        )
        .drop("_t")
    )


def extract_and_predict(
    df: DataFrame,
    document_type: str | None = None,
    include_entities: bool = True,
    include_sentiment: bool = True,
    include_patterns: bool = True,
) -> DataFrame:
    """Per text: type, entities, sentiment, their overall confidence and the list of steps.

    The switches drop whole columns from the plan, and with them their cost. A given
    ``document_type`` skips the classification and leaves it out of the confidence.
    ``include_patterns=False`` ignores pattern entities in the confidence.
    """
    text = F.col("text")
    out = df.withColumn("text_length", F.length(text))
    steps, type_conf = [], F.lit(None).cast("double")
    if document_type is None:
        out = out.withColumn("document_type_prediction", classify.document_type(text))
        kind, type_conf = (
            F.col("document_type_prediction.document_type"),
            F.col("document_type_prediction.confidence"),
        )
        steps.append("document_type_prediction")
    else:
        out = out.withColumn("document_type", F.lit(document_type))
        kind = F.lit(document_type)
    entity_conf, score = F.lit(None).cast("double"), F.lit(None).cast("double")
    if include_sentiment or include_entities:  # cleaning costs more than what follows: tokens and sentiment share it
        out = out.withColumn("_tokens", prep.tokenize(prep.clean_text(text)))
    if include_entities:
        out = out.withColumns(
            {
                "patterns": pattern_entities(text),
                "document_specific": document_fields(kind, text),
                # Counted apart from the places, which cost much more and are often left unread.
                "entity_count": F.aggregate(
                    pattern_counts(text), F.lit(0).cast("bigint"), lambda acc, c: acc + c["entities"]
                ),
            }
        )
        if include_patterns:  # every pattern has the same confidence
            entity_conf = F.when(F.col("entity_count") > 0, F.lit(CONFIDENCE["patterns"]))
        steps.append("entity_extraction")
        out = out.withColumn(
            "nlp_analysis",
            F.struct(
                F.length(text).alias("original_length"),
                F.size(prep.preprocess_tokens(F.col("_tokens"))).alias("processed_tokens"),
                F.size(prep.sentences(text)).alias("sentences"),
            ),
        )
        steps.append("nlp_analysis")
    if include_sentiment or include_entities:
        out = out.withColumn("sentiment", classify.sentiment_of(classify.token_hits(F.col("_tokens")))).drop("_tokens")
        score = F.col("sentiment.score")
        if include_entities:
            steps.append("sentiment_analysis")
    return out.withColumns(
        {
            "overall_confidence": overall_confidence(type_conf, entity_conf, score),
            "processing_steps": F.array(*[F.lit(s) for s in steps]).cast("array<string>"),
        }
    )


def process_documents(df: DataFrame, include_summary: bool = True) -> DataFrame:
    """Language analysis of a corpus: lengths, tokens, type, sentiment, summary."""
    text = F.col("text")
    best = classify.document_type(text)
    # Cleaning costs more than all that follows, so tokens and sentiment share it.
    read = let(
        prep.tokenize(prep.clean_text(text)),
        lambda t: F.struct(
            F.size(prep.preprocess_tokens(t)).alias("processed_tokens"), classify.sentiment_of(classify.token_hits(t)).alias("sentiment")
        ),
    )
    out = df.select("document_id", F.length(text).alias("original_length"), best.alias("document_type"), read.alias("_read"))
    out = out.select("document_id", "original_length", "_read.processed_tokens", "document_type", "_read.sentiment")
    if include_summary:
        out = out.join(extractive_summary(df), "document_id", "left")
    return out


def process_image_texts(df: DataFrame) -> DataFrame:
    """Predictions for recognised texts; short ones get a warning instead."""
    enough = prep.enough_for_image(F.col("text"))
    return df.withColumns(
        {
            "success": enough,
            "prediction": F.when(enough, classify.document_type(F.col("text"))),
            "warning": F.when(~enough, "Insufficient text extracted for predictions"),
        }
    )
