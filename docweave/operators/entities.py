"""Long entity tables: one row per entity, from every extraction method."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from docweave.functions import entities as cols
from docweave.functions import validate
from docweave.functions.fields import document_fields
from docweave.functions.regex import SPACE, WORD, find_spans, strip
from docweave.sources.stored import stored


def explode_entities(df: DataFrame, spans: Column, id_col: str = "document_id") -> DataFrame:
    """One row per entity of an entity array."""
    return df.select(id_col, F.inline(spans))


def extract(
    df: DataFrame,
    names: list[str] | None = None,
    registry: Mapping[str, str] | None = None,
    id_col: str = "document_id",
    text_col: str = "text",
) -> DataFrame:
    """Pattern entities of a corpus in one pass over the texts."""
    return explode_entities(df, cols.pattern_entities(F.col(text_col), names, registry), id_col)


def extract_financial(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    return explode_entities(df, cols.financial_entities(F.col("text"), names))


def extract_addresses(df: DataFrame) -> DataFrame:
    return explode_entities(df, cols.address_entities(F.col("text")))


_NAME_WORD = "[" + WORD + "#]"
_IN_NAME = f"[{SPACE}]+{_NAME_WORD}+"


def _beginnings(df: DataFrame, names: DataFrame, id_col: str) -> DataFrame:
    """``(id, words)`` of the texts in which some name may begin: their words that begin one."""
    first = names.select(F.element_at(F.split("name", " "), 1).alias("word")).distinct()
    words = F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(f"{_NAME_WORD}+"), F.lit(0)))
    met = df.select(id_col, F.explode(words).alias("word")).join(first, "word", "left_semi")
    return met.groupBy(id_col).agg(F.collect_set("word").alias("_words"))


def gazetteer_entities(
    df: DataFrame, names: DataFrame, max_words: int | None = None, id_col: str = "document_id"
) -> DataFrame:
    """Tag the names of a dictionary in the texts (stands in for the pretrained taggers).

    The distinct words of a text are looked up among the first words of ``names(name, label)``; texts
    without any take no further part. Where one occurs, the words after it are read as far as the longest
    name, or ``max_words``, reaches, and the run grows word by word as long as some name begins with it,
    which a semi join on the names' beginnings of that many words tells. So the work grows with the places
    at which names begin, not with words times names. Words of a name are parted by blanks of any kind in
    the text and by single blanks in the dictionary. Of names inside each other the longest stays.
    """
    if max_words is None:
        max_words = names.agg(F.max(F.size(F.split("name", " ")))).first()[0] or 1
    texts = df.select(id_col, "text")
    some = texts.join(_beginnings(texts, names, id_col), id_col)
    after = f"(?=((?:{_IN_NAME}){{0,{max_words - 1}}}))"
    begins = F.concat(F.lit(f"(?<!{_NAME_WORD})(?:"), F.array_join("_words", "|"), F.lit(f")(?!{_NAME_WORD}){after}"))
    run = some.select(id_col, F.inline(find_spans(F.col("text"), begins, 1)))
    run = run.select(id_col, "text", "start", "end", F.regexp_extract_all("value", F.lit(_IN_NAME), F.lit(0)).alias("_more"))
    if max_words > 1:
        run = stored(run, "beginnings")  # read once for each number of words
    parts = F.split("name", " ")
    found = []
    for size in range(1, max_words + 1):
        if size > 1:
            grown = F.get("_more", F.lit(size - 2))
            run = run.where(F.size("_more") >= size - 1).select(
                id_col, F.concat_ws(" ", "text", strip(grown)).alias("text"), "start", (F.col("end") + F.length(grown)).alias("end"), "_more"
            )
            beginnings = names.where(F.size(parts) >= size).select(F.array_join(F.slice(parts, 1, size), " ").alias("text"))
            run = run.join(beginnings.distinct(), "text", "left_semi")
        known = names.where(F.size(parts) == size).select(F.col("name").alias("text"), "label")
        found.append(run.join(known, "text").select(id_col, "text", "label", "start", "end"))
    tagged = reduce(DataFrame.unionByName, found)
    # A name inside another one: something that began earlier, or there and longer, reaches as far.
    place = F.col("start").cast("long") * (1 << 31) - F.col("end")
    before = W.Window.partitionBy(id_col).orderBy(place).rangeBetween(W.Window.unboundedPreceding, -1)
    outer = tagged.withColumn("_reach", F.max("end").over(before))
    return outer.where(F.col("_reach").isNull() | (F.col("_reach") < F.col("end"))).select(
        id_col,
        "text",
        "label",
        "start",
        "end",
        F.lit(1.0).alias("confidence"),
        F.lit("gazetteer").alias("method"),
    )


def validated(entities: DataFrame) -> DataFrame:
    """Add ``is_valid`` and ``normalized`` to a long entity table."""
    kind, text = F.col("entity_type"), F.col("text")
    return entities.withColumns(
        {
            "is_valid": validate.is_valid(kind, text),
            "normalized": validate.normalized(kind, text),
        }
    )


def only_valid(entities: DataFrame) -> DataFrame:
    """E-mails, phones and dates that pass, and every currency; other types are left out."""
    return entities.where(validate.is_valid(F.col("entity_type"), F.col("text")))


def document_specific(df: DataFrame) -> DataFrame:
    """Fields of the extractor that the document type selects."""
    return df.select("document_id", document_fields(F.col("document_type"), F.col("text")).alias("f")).select(
        "document_id", "f.*"
    )


def _typed_fields(f: Column) -> Column:
    """The fields of ``document_fields`` as an array of ``(entity_type, text)``."""

    def one(label: str, value: Column) -> Column:
        return F.struct(F.lit(label).alias("entity_type"), value.alias("text"))

    def many(label: str, values: Column) -> Column:
        none = F.array().cast("array<struct<entity_type:string,text:string>>")
        return F.coalesce(F.transform(values, lambda v: one(label, v)), none)

    single = F.array(
        *[one(f"invoice.{n}", f["invoice"][n]) for n in ("number", "date", "due_date", "total")],
        one("resume.name", f["resume"]["name"]),
        *[one(f"contract.{n}", f["contract"][n]) for n in ("party_a", "party_b", "effective_date", "duration")],
    )
    return F.concat(
        F.filter(single, lambda s: s["text"].isNotNull()),
        many("resume.education", f["resume"]["education"]),
        many("resume.experience", f["resume"]["experience"]),
    )


def specific_rows(df: DataFrame) -> DataFrame:
    """``document_specific`` as long rows ``(document_id, entity_type, text)``."""
    fields = document_fields(F.col("document_type"), F.col("text"))
    return df.select("document_id", fields.alias("f")).select("document_id", F.inline(_typed_fields(F.col("f"))))


def extract_all(df: DataFrame, timestamp: Column) -> DataFrame:
    """Everything the registries and the type's own extractor find, one row per document.

    ``df(document_id, document_type, text)``. The result has the ``timestamp`` given, the text length and
    three arrays: ``patterns``, those of them that are ``validated`` (see ``only_valid``), and the fields of
    the type's own extractor as ``document_specific``.
    """
    text = F.col("text")
    valid = F.filter("patterns", lambda s: F.coalesce(validate.is_valid(s["entity_type"], s["text"]), F.lit(False)))
    return (
        df.select("document_id", "document_type", "text", cols.pattern_entities(text).alias("patterns"))
        .withColumn("validated", valid)
        .select(
            "document_id",
            "document_type",
            timestamp.alias("timestamp"),
            F.length(text).alias("text_length"),
            "patterns",
            "validated",
            document_fields(F.col("document_type"), text).alias("document_specific"),
        )
    )


def all_rows(extracted: DataFrame) -> DataFrame:
    """``extract_all`` as long rows, one per entity and part; a document without any keeps one row."""
    kind = "array<struct<part:string,entity_type:string,text:string,start:int,end:int,confidence:double,method:string>>"

    def spans(part: str, column: str) -> Column:
        names = ("entity_type", "text", "start", "end", "confidence", "method")
        return F.transform(column, lambda s: F.struct(F.lit(part).alias("part"), *[s[n].alias(n) for n in names])).cast(kind)

    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("start", "int"), ("end", "int"), ("confidence", "double"))]
    specific = F.transform(
        _typed_fields(F.col("document_specific")),
        lambda s: F.struct(F.lit("document_specific").alias("part"), s["entity_type"], s["text"], *nothing, F.lit("document_specific").alias("method")),
    ).cast(kind)
    rows = F.concat(spans("patterns", "patterns"), spans("validated", "validated"), specific)
    return extracted.select("document_id", "document_type", "timestamp", "text_length", F.inline_outer(rows))


def union_methods(*tables: DataFrame) -> DataFrame:
    """Entity tables of several methods in one; columns a method lacks become NULL."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def flatten_entities(df: DataFrame, parts: Mapping[str, Column]) -> DataFrame:
    """Nested entity arrays to rows typed by dotted path (``patterns.email``)."""
    named = [F.struct(F.lit(prefix + ".").alias("_path"), spans.alias("_spans")) for prefix, spans in parts.items()]
    rows = df.select("document_id", F.inline(F.array(*named))).select("document_id", "_path", F.inline("_spans"))
    return rows.withColumn("entity_type", F.concat("_path", "entity_type")).drop("_path")


def entity_counts(entities: DataFrame, by: Sequence[str] = ("document_id", "entity_type")) -> DataFrame:
    return entities.groupBy(*by).agg(F.count("*").alias("entities"))


def entity_summary(entities: DataFrame) -> DataFrame:
    """Per document: total, distinct types and methods, and the confidence range."""
    return entities.groupBy("document_id").agg(
        F.count("*").alias("total_entities"),
        F.array_sort(F.collect_set("entity_type")).alias("entity_types"),
        F.array_sort(F.collect_set("method")).alias("extraction_methods"),
        F.avg("confidence").alias("avg_confidence"),
        F.min("confidence").alias("min_confidence"),
        F.max("confidence").alias("max_confidence"),
    )
