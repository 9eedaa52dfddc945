"""Pages, engines, words and forms of recognised documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.catalog.registry import query, with_tables
from docweave.operators import ocr, relational
from docweave.sources import derived
from docweave.sources.tables import load

PAGES = f"""WITH paged AS (SELECT doc_id AS document_id, text, unnest(range(1, 1 + greatest(1,
  CAST(ceil(length(text) / {derived.PAGE_CHARS}.0) AS BIGINT)))) AS page FROM documents),
pages2 AS (SELECT document_id, page, {derived.OCR_COLUMNS} FROM paged
  UNION ALL SELECT document_id, page, {derived.VISION_COLUMNS} FROM paged)"""


@query(
    "agg_pdf_pages",
    f"""{PAGES} SELECT document_id, coalesce(string_agg(text, chr(10) ORDER BY page) FILTER (WHERE text <> ''), '') AS text,
round(coalesce(sum(confidence) FILTER (WHERE text <> ''), 0) / count(*), 9) AS confidence, count(*) AS pages
FROM pages2 WHERE engine = 'tesseract' GROUP BY document_id""",
)
def agg_pdf_pages(spark: SparkSession, base: str) -> DataFrame:
    pages = derived.ocr_pages(spark, base).where("engine = 'tesseract'")
    return ocr.join_pages(pages).withColumn("confidence", F.round("confidence", 9))


@query(
    "win_page_number",
    """SELECT doc_id AS document_id, i::INTEGER AS page, parts[i] AS text FROM (
SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS parts FROM documents))""",
)
def win_page_number(spark: SparkSession, base: str) -> DataFrame:
    docs = derived.source(spark, base, "documents").withColumnRenamed("doc_id", "document_id")
    return ocr.number_pages(docs, F.split("text", "\n\n"))


BEST = """SELECT document_id, page::INTEGER AS page, engine, confidence, length(text)::INTEGER AS chars FROM (
SELECT *, row_number() OVER (PARTITION BY document_id, page ORDER BY {0} DESC, CASE engine WHEN 'tesseract' THEN 0 ELSE 1 END) AS r FROM pages2) WHERE r = 1"""


@query("argmax_best_ocr", f"{PAGES} {BEST.format('confidence')}")
def argmax_best_ocr(spark: SparkSession, base: str) -> DataFrame:
    return ocr.best_engine(derived.ocr_pages(spark, base)).select(
        "document_id", "page", "engine", "confidence", F.length("text").alias("chars")
    )


NORMAL = "CASE engine WHEN 'tesseract' THEN confidence / 100 ELSE confidence END"


@query("argmax_best_ocr_normalized", f"{PAGES} {BEST.format(NORMAL)}")
def argmax_best_ocr_normalized(spark: SparkSession, base: str) -> DataFrame:
    return ocr.best_engine(derived.ocr_pages(spark, base), normalise=True).select(
        "document_id", "page", "engine", "confidence", F.length("text").alias("chars")
    )


@query(
    "fallback_ocr",
    f"""{PAGES} SELECT v.document_id, v.page::INTEGER AS page, CASE WHEN v.confidence > 0.5 THEN v.engine ELSE t.engine END AS engine,
CASE WHEN v.confidence > 0.5 THEN v.confidence ELSE t.confidence END AS confidence,
length(CASE WHEN v.confidence > 0.5 THEN v.text ELSE t.text END)::INTEGER AS chars
FROM pages2 v JOIN pages2 t USING (document_id, page) WHERE v.engine = 'google_vision' AND t.engine = 'tesseract'""",
)
def fallback_ocr(spark: SparkSession, base: str) -> DataFrame:
    return ocr.fallback_engine(derived.ocr_pages(spark, base)).select(
        "document_id", "page", "engine", "confidence", F.length("text").alias("chars")
    )


# Word confidences per page of a document: one per word, some of them -1 as for layout boxes.
WORD_CONF = "list_transform(string_split(text, ' '), lambda w: CASE WHEN length(w) % 3 = 0 THEN -1 ELSE least(length(w) * 9, 99) END)"


def _word_confidences() -> F.Column:
    return F.transform(
        F.split("text", " "),
        lambda w: F.when(F.length(w) % 3 == 0, F.lit(-1)).otherwise(F.least(F.length(w) * 9, F.lit(99))),
    )


@query(
    "agg_word_confidence",
    f"""SELECT doc_id AS document_id, round(coalesce(list_avg(list_filter({WORD_CONF}, lambda c: c > 0)), 0), 9) AS confidence FROM documents""",
)
def agg_word_confidence(spark: SparkSession, base: str) -> DataFrame:
    docs = derived.source(spark, base, "documents").select(F.col("doc_id").alias("document_id"), _word_confidences().alias("c"))
    return docs.select("document_id", F.round(ocr.word_confidence(F.col("c")), 9).alias("confidence"))


@query(
    "filter_word_confidence",
    f"SELECT doc_id AS document_id, len(list_filter({WORD_CONF}, lambda c: c > 0))::INTEGER AS kept FROM documents",
)
def filter_word_confidence(spark: SparkSession, base: str) -> DataFrame:
    return derived.source(spark, base, "documents").select(
        F.col("doc_id").alias("document_id"), F.size(F.filter(_word_confidences(), lambda c: c > 0)).alias("kept")
    )


ANNOTATIONS = "list_transform(string_split(text, '.'), lambda s: CASE WHEN length(s) % 5 = 0 THEN NULL ELSE (length(s) % 100) / 100::DOUBLE END)"


@query(
    "agg_annotation_confidence",
    f"""SELECT document_id, CASE WHEN len(a) <= 1 THEN 1.0 ELSE round(coalesce(list_avg(list_filter(a[2:], lambda c: c IS NOT NULL)), 0), 9) END::DOUBLE AS confidence
FROM (SELECT doc_id AS document_id, {ANNOTATIONS} AS a FROM documents)""",
)
def agg_annotation_confidence(spark: SparkSession, base: str) -> DataFrame:
    a = F.transform(
        F.split("text", r"\."), lambda s: F.when(F.length(s) % 5 != 0, (F.length(s) % 100) / F.lit(100.0))
    )
    docs = derived.source(spark, base, "documents").select(F.col("doc_id").alias("document_id"), a.alias("a"))
    return docs.select("document_id", F.round(ocr.annotation_confidence(F.col("a")), 9).alias("confidence"))


@query(
    "agg_blocks_text",
    """SELECT document_id, block::INTEGER AS block, array_to_string(list_filter(string_split(line, ' '), lambda w: w <> ''), ' ') AS text FROM (
SELECT doc_id AS document_id, unnest(range(0, len(ls))) AS block, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))""",
)
def agg_blocks_text(spark: SparkSession, base: str) -> DataFrame:
    """Blocks given as words given as symbols, back to text."""
    lines = derived.source(spark, base, "documents").select(
        F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("block", "line")
    )
    words = F.transform(F.filter(F.split("line", " "), lambda w: w != ""), lambda w: F.split(w, ""))
    return lines.select("document_id", "block", words.alias("words")).select(
        "document_id", "block", ocr.block_text(F.col("words")).alias("text")
    )


@query(
    "form_key_values",
    with_tables(texts=["invoices", "cards"])
    + r""", m AS (SELECT document_id, regexp_extract_all(text, '(?m)^([^:\n]+):[ \t]*(\S.*)$', 1) AS ks,
regexp_extract_all(text, '(?m)^([^:\n]+):[ \t]*(\S.*)$', 2) AS vs FROM texts)
SELECT document_id, unnest(ks) AS key, unnest(vs) AS value FROM m""",
)
def form_key_values(spark: SparkSession, base: str) -> DataFrame:
    return relational.form_key_values(derived.texts(spark, base, ["invoices", "cards"]))


CELLS = """SELECT l_orderkey AS document_id, 0 AS table_no, l_linenumber AS row_index, 0 AS column_index, cast(l_partkey as string) AS content FROM {lineitem}
UNION ALL SELECT l_orderkey, 0, l_linenumber, 1, cast(cast(l_quantity as bigint) as string) FROM {lineitem}
UNION ALL SELECT l_orderkey, 0, l_linenumber, 2, l_returnflag FROM {lineitem}"""


@query(
    "form_table_grid",
    f"""SELECT document_id, table_no, row_index, string_agg(content, '|' ORDER BY column_index, content) AS cells
FROM ({CELLS.format(lineitem='lineitem')}) GROUP BY ALL""",
)
def form_table_grid(spark: SparkSession, base: str) -> DataFrame:
    line = load(spark, base, "lineitem")
    contents = [F.col("l_partkey").cast("string"), F.col("l_quantity").cast("bigint").cast("string"), F.col("l_returnflag")]
    columns = [F.struct(F.lit(i).alias("column_index"), c.alias("content")) for i, c in enumerate(contents)]
    cells = line.select(
        F.col("l_orderkey").alias("document_id"), F.lit(0).alias("table_no"), F.col("l_linenumber").alias("row_index"), F.inline(F.array(*columns))
    )
    return relational.form_grid(cells).withColumn("cells", F.array_join("cells", "|"))
