"""Keyword document types, service labels and lexicon sentiment."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions.regex import let
from docweave.functions.text import clean_text, tokenize

# Keywords per document type, in the order that breaks ties.
KEYWORDS: dict[str, list[str]] = {
    "invoice": ["invoice", "bill", "amount due", "payment", "total"],
    "contract": ["agreement", "terms", "conditions", "parties", "signature"],
    "resume": ["experience", "education", "skills", "employment", "qualifications"],
    "report": ["summary", "analysis", "findings", "conclusion", "recommendation"],
    "email": ["from:", "to:", "subject:", "dear", "sincerely"],
    "letter": ["dear", "sincerely", "yours truly", "best regards"],
}
# Labels of a deployed classifier, by index.
SERVICE_TYPES = ["invoice", "contract", "resume", "report", "email"]

# Re-aim: a small default lexicon in place of a pretrained sentiment model.
POSITIVE = "good great excellent happy pleased best better love benefit success win thank thanks agree".split()
NEGATIVE = "bad poor terrible sad angry worst worse hate loss failure fail error problem never die".split()


def keyword_scores(text: Column, registry: Mapping[str, list[str]] = KEYWORDS) -> Column:
    """``STRUCT<type: matched keywords / keywords>`` on the lower-cased text."""

    def score(low: Column, words: list[str]) -> Column:
        hits = [low.contains(w).cast("int") for w in words]
        total = hits[0]
        for hit in hits[1:]:
            total = total + hit
        return total / F.lit(float(len(words)))

    return let(
        F.lower(text),
        lambda low: F.struct(*[score(low, w).alias(name) for name, w in registry.items()]),
    )


def document_type(text: Column, registry: Mapping[str, list[str]] = KEYWORDS) -> Column:
    """``STRUCT<document_type,confidence,scores MAP,method>``; the first of equal types wins.

    A text without any keyword gets the first type with confidence 0.0.
    """
    names = list(registry)

    def pick(s: Column) -> Column:
        best = F.greatest(*[s[n] for n in names])
        chain = F.when(s[names[0]] == best, F.lit(names[0]))
        for n in names[1:]:
            chain = chain.when(s[n] == best, F.lit(n))
        return F.struct(
            chain.alias("document_type"),
            best.alias("confidence"),
            F.create_map(*[x for n in names for x in (F.lit(n), s[n])]).alias("scores"),
            F.lit("pattern_matching").alias("method"),
        )

    return let(keyword_scores(text, registry), pick)


def decode_label(index: Column, labels: list[str]) -> Column:
    """Label of a class index; ``unknown`` outside the list."""
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in labels]), index), F.lit("unknown"))


def score_map(scores: Column, labels: list[str]) -> Column:
    """Class scores by label; surplus scores are dropped."""
    return F.map_from_arrays(
        F.slice(F.array(*[F.lit(x) for x in labels]), F.lit(1), F.size(scores)),
        F.slice(scores, 1, len(labels)),
    )


def best_class(scores: Column) -> Column:
    """Zero-based index of the first maximum."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def sentiment_hits(
    text: Column, positive: Iterable[str] = POSITIVE, negative: Iterable[str] = NEGATIVE
) -> Column:
    """``STRUCT<pos,neg>``: lexicon words in the cleaned text."""
    return let(tokenize(clean_text(text)), lambda t: token_hits(t, positive, negative))


def token_hits(tokens: Column, positive: Iterable[str] = POSITIVE, negative: Iterable[str] = NEGATIVE) -> Column:
    """``sentiment_hits`` of the tokens of a cleaned text."""
    pos, neg = list(positive), list(negative)
    return F.struct(
        F.size(F.filter(tokens, lambda w: w.isin(*pos))).alias("pos"),
        F.size(F.filter(tokens, lambda w: w.isin(*neg))).alias("neg"),
    )


def sentiment(text: Column, positive=POSITIVE, negative=NEGATIVE) -> Column:
    """``STRUCT<label,score>``; nothing to go by gives UNKNOWN with score 0.0."""
    return sentiment_of(sentiment_hits(text, positive, negative))


def sentiment_of(hits: Column) -> Column:
    """``sentiment`` of counted hits."""

    def label(h: Column) -> Column:
        most, all_ = F.greatest(h["pos"], h["neg"]), h["pos"] + h["neg"]
        return F.struct(
            F.when(all_ == 0, "UNKNOWN")
            .when(h["pos"] >= h["neg"], "POSITIVE")
            .otherwise("NEGATIVE")
            .alias("label"),
            F.when(all_ == 0, F.lit(0.0)).otherwise(most / all_).alias("score"),
        )

    return let(hits, label)


def sentiment_3way(text: Column, positive=POSITIVE, negative=NEGATIVE) -> Column:
    """``STRUCT<positive,neutral,negative,sentiment>``; the three scores add up to one."""

    def share(h: Column) -> Column:
        whole = h["pos"] + h["neg"] + 1
        p, u, n = h["pos"] / whole, 1 / whole, h["neg"] / whole
        return F.struct(
            p.alias("positive"),
            u.alias("neutral"),
            n.alias("negative"),
            F.when((h["pos"] > h["neg"]) & (h["pos"] >= 1), "positive")
            .when((h["neg"] > h["pos"]) & (h["neg"] >= 1), "negative")
            .when(h["pos"] >= 1, "mixed")
            .otherwise("neutral")
            .alias("sentiment"),
        )

    return let(sentiment_hits(text, positive, negative), share)
