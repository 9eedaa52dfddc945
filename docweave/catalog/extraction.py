"""Pattern, financial, address and document-specific entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.catalog.registry import literal, query, re2, with_tables
from docweave.functions import entities as cols
from docweave.functions import fields, validate
from docweave.functions.regex import find_spans
from docweave.operators import entities as ops
from docweave.sources import derived
from docweave.sources.tables import load


def positions(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"start": "start_position", "end": "end_position"})


def found(name: str, pattern: str, confidence: float, group: int | None = None, strip: bool = False, source: str = "texts") -> str:
    """SELECT of all matches of one pattern with offsets, from the gaps between matches."""
    re = re2(pattern)
    values = f"regexp_extract_all(text, {re}, {group})" if group else "NULL::VARCHAR[]"
    shown = r"regexp_replace(ms[i], '^\s+|\s+$', '', 'g')" if strip else "ms[i]"
    return rf"""SELECT document_id, {literal(name)} AS entity_type, {shown} AS text,
  before::INTEGER AS start_position, (before + length(ms[i]))::INTEGER AS end_position,
  vs[i] AS value, {confidence}::DOUBLE AS confidence
FROM (SELECT *, list_sum(list_transform(gs[1:i], lambda g: length(g)))
        + coalesce(list_sum(list_transform(ms[1:i-1], lambda m: length(m))), 0) AS before
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i
    FROM (SELECT document_id, regexp_extract_all(text, {re}) AS ms, {values} AS vs,
            string_split_regex(text, {re}) AS gs
      FROM {source} WHERE regexp_matches(text, {re}))))"""


TEXTS = with_tables(texts=derived.TEXTS)
COLUMNS = ["document_id", "entity_type", "text", "start_position", "end_position", "value", "confidence"]


def _pattern_query(name: str):
    def run(spark: SparkSession, base: str) -> DataFrame:
        return positions(ops.extract(derived.texts(spark, base), [name])).select(*COLUMNS)

    return run


def _financial_query(name: str):
    def run(spark: SparkSession, base: str) -> DataFrame:
        return positions(ops.extract_financial(derived.texts(spark, base), [name])).select(*COLUMNS)

    return run


for _name, _pattern in cols.PATTERNS.items():
    query(f"extract_{_name}", f"{TEXTS}\n{found(_name, _pattern, 0.9)}")(_pattern_query(_name))
for _name, _pattern in cols.FINANCIAL.items():
    _key = f"fin_{_name}"
    query(_key, f"{TEXTS}\n{found(_name, _pattern, 0.85, 1)}")(_financial_query(_name))


@query("extract_address", f"{TEXTS}\n{found('address', cols.ADDRESS, 0.8, strip=True)}")
def extract_address(spark: SparkSession, base: str) -> DataFrame:
    return positions(ops.extract_addresses(derived.texts(spark, base))).select(*COLUMNS)


ALL_PATTERNS = "\nUNION ALL\n".join(found(n, p, 0.9) for n, p in cols.PATTERNS.items())
ALL_FINANCIAL = "\nUNION ALL\n".join(found(n, p, 0.85, 1) for n, p in cols.FINANCIAL.items())


@query("entity_explode", f"{TEXTS}\n{ALL_PATTERNS}")
def entity_explode(spark: SparkSession, base: str) -> DataFrame:
    """All thirteen patterns in one pass over the texts."""
    return positions(ops.extract(derived.texts(spark, base))).select(*COLUMNS)


# A caller's own patterns beside the given ones.
CUSTOM = {"order_ref": r"PO-\d{10}", "currency": cols.PATTERNS["currency"]}


@query(
    "pattern_registry",
    f"{TEXTS}\n" + "\nUNION ALL\n".join(found(n, p, 0.9) for n, p in CUSTOM.items()),
)
def pattern_registry(spark: SparkSession, base: str) -> DataFrame:
    out = ops.extract(derived.texts(spark, base), registry=CUSTOM)
    return positions(out).select(*COLUMNS)


@query(
    "agg_entity_counts",
    f"""{TEXTS}, e AS ({ALL_PATTERNS})
SELECT document_id, entity_type, count(*) AS entities FROM e GROUP BY ALL""",
)
def agg_entity_counts(spark: SparkSession, base: str) -> DataFrame:
    """A document is one row, so its entities are counted there."""
    counts = cols.pattern_counts(F.col("text"))
    return derived.texts(spark, base).select("document_id", F.inline(counts))


@query(
    "agg_entity_summary",
    f"""{TEXTS}, e AS (
SELECT *, 'patterns' AS method FROM ({ALL_PATTERNS})
UNION ALL SELECT *, 'financial' AS method FROM ({ALL_FINANCIAL}))
SELECT document_id, count(*) AS total_entities,
  array_to_string(list_sort(list_distinct(list(entity_type))), ',') AS entity_types,
  array_to_string(list_sort(list_distinct(list(method))), ',') AS extraction_methods,
  round(avg(confidence), 9) AS avg_confidence, min(confidence) AS min_confidence,
  max(confidence) AS max_confidence
FROM e GROUP BY document_id""",
)
def agg_entity_summary(spark: SparkSession, base: str) -> DataFrame:
    corpus = derived.texts(spark, base)
    spans = F.concat(cols.pattern_entities(F.col("text")), cols.financial_entities(F.col("text")))
    return ops.entity_summary(ops.explode_entities(corpus, spans)).withColumns(
        {
            "entity_types": F.array_join("entity_types", ","),
            "extraction_methods": F.array_join("extraction_methods", ","),
            "avg_confidence": F.round("avg_confidence", 9),
        }
    )


@query(
    "flatten_entities",
    f"""{TEXTS}, e AS (
SELECT 'patterns' AS part, * FROM ({ALL_PATTERNS})
UNION ALL SELECT 'financial' AS part, * FROM ({ALL_FINANCIAL}))
SELECT document_id, part || '.' || entity_type AS entity_type, text, start_position, end_position FROM e""",
)
def flatten_entities(spark: SparkSession, base: str) -> DataFrame:
    text = F.col("text")
    parts = {"patterns": cols.pattern_entities(text), "financial": cols.financial_entities(text)}
    out = ops.flatten_entities(derived.texts(spark, base), parts)
    return positions(out).select("document_id", "entity_type", "text", "start_position", "end_position")


# --- validation -------------------------------------------------------------------------------

CHECKED = ["email", "phone", "date", "currency"]
FOUND = f"{TEXTS}, e AS (" + "\nUNION ALL\n".join(found(n, cols.PATTERNS[n], 0.9) for n in CHECKED) + ")"
DIGITS = r"regexp_replace(text, '\D', '', 'g')"
PHONE = f"""CASE WHEN length({DIGITS}) = 10 THEN '(' || substr({DIGITS}, 1, 3) || ') ' || substr({DIGITS}, 4, 3) || '-' || substr({DIGITS}, 7)
  WHEN length({DIGITS}) = 11 AND starts_with({DIGITS}, '1') THEN '1-(' || substr({DIGITS}, 2, 3) || ') ' || substr({DIGITS}, 5, 3) || '-' || substr({DIGITS}, 8) END"""
DATE = "coalesce(" + ", ".join(
    f"try_strptime(text, '{f}')" for f in ["%m/%d/%Y", "%d/%m/%Y", "%Y-%m-%d", "%m-%d-%Y", "%d-%m-%Y", "%Y/%m/%d"]
) + ")::DATE"
AMOUNT = r"coalesce(try_cast(regexp_replace(text, '[\$,]', '', 'g') AS DOUBLE), 0.0)"
EMAIL_OK = f"regexp_matches(text, {literal(validate.EMAIL)})"


def _found(spark: SparkSession, base: str, *names: str) -> DataFrame:
    return positions(ops.extract(derived.texts(spark, base), list(names)))


def _only(name: str) -> str:
    return f"{TEXTS}, e AS ({found(name, cols.PATTERNS[name], 0.9)})"


@query(
    "validate_email",
    f"{_only('email')} SELECT document_id, start_position, text, {EMAIL_OK} AS is_valid FROM e",
)
def validate_email(spark: SparkSession, base: str) -> DataFrame:
    return _found(spark, base, "email").select(
        "document_id", "start_position", "text", validate.valid_email(F.col("text")).alias("is_valid")
    )


@query(
    "normalize_phone",
    f"{_only('phone')} SELECT document_id, start_position, text, {PHONE} AS normalized FROM e",
)
def normalize_phone(spark: SparkSession, base: str) -> DataFrame:
    return _found(spark, base, "phone").select(
        "document_id", "start_position", "text", validate.normalized_phone(F.col("text")).alias("normalized")
    )


@query(
    "parse_date_multi",
    f"{_only('date')} SELECT document_id, start_position, text, CAST({DATE} AS VARCHAR) AS parsed FROM e",
)
def parse_date_multi(spark: SparkSession, base: str) -> DataFrame:
    return _found(spark, base, "date").select(
        "document_id", "start_position", "text", validate.parsed_date(F.col("text")).cast("string").alias("parsed")
    )


@query(
    "clean_currency",
    f"{_only('currency')} SELECT document_id, start_position, text, {AMOUNT} AS amount FROM e",
)
def clean_currency(spark: SparkSession, base: str) -> DataFrame:
    return _found(spark, base, "currency").select(
        "document_id", "start_position", "text", validate.clean_currency(F.col("text")).alias("amount")
    )


@query(
    "validate_entities",
    f"""{FOUND} SELECT document_id, entity_type, start_position, text,
CASE entity_type WHEN 'email' THEN {EMAIL_OK} WHEN 'phone' THEN ({PHONE}) IS NOT NULL
  WHEN 'date' THEN {DATE} IS NOT NULL ELSE true END AS is_valid,
CASE entity_type WHEN 'phone' THEN {PHONE} WHEN 'date' THEN CAST({DATE} AS VARCHAR) WHEN 'email' THEN text END AS normalized,
CASE entity_type WHEN 'currency' THEN {AMOUNT} END AS amount FROM e""",
)
def validate_entities(spark: SparkSession, base: str) -> DataFrame:
    money = F.col("entity_type") == "currency"
    return ops.validated(_found(spark, base, *CHECKED)).select(
        "document_id",
        "entity_type",
        "start_position",
        "text",
        "is_valid",
        F.when(~money, F.col("normalized")).alias("normalized"),
        F.when(money, F.col("normalized").cast("double")).alias("amount"),
    )


@query(
    "filter_valid_entities",
    f"""{FOUND} SELECT document_id, entity_type, start_position, text FROM e
WHERE CASE entity_type WHEN 'email' THEN {EMAIL_OK} WHEN 'phone' THEN ({PHONE}) IS NOT NULL
  WHEN 'date' THEN {DATE} IS NOT NULL ELSE true END""",
)
def filter_valid_entities(spark: SparkSession, base: str) -> DataFrame:
    out = ops.only_valid(_found(spark, base, *CHECKED))
    return out.select("document_id", "entity_type", "start_position", "text")


# --- document-specific fields -----------------------------------------------------------------


def first(pattern: str, group: int = 1, flags: str = "i") -> str:
    return f"nullif(regexp_extract(text, {re2(pattern, flags)}, {group}), '')"


def consuming(pattern: str) -> str:
    """Without look-ahead: what would be looked at is consumed."""
    return pattern.replace("(?=", "(?:")


STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
INVOICE_SQL = ", ".join(f"{first(p)} AS {n}" for n, p in fields.INVOICE.items())
NAME = STRIP.format(
    r"list_filter(string_split(text, chr(10)), lambda line: regexp_replace(line, '\s', '', 'g') <> '')[1]"
)
EDUCATION = f"regexp_extract_all(regexp_extract(text, {re2(consuming(fields.EDUCATION), 'is')}, 1), {re2(consuming(fields.DEGREE))}, 1)"
EXPERIENCE = f"regexp_extract_all(regexp_extract(text, {re2(consuming(fields.EXPERIENCE), 'is')}, 1), {re2(fields.JOB)}, 1)"
PARTY = [
    STRIP.format("coalesce(" + ", ".join(first(p, g) for p in fields.PARTIES) + ")") for g in (1, 2)
]
DURATION = f"nullif(concat_ws(' ', {first(fields.TERM, 1)}, {first(fields.TERM, 2)}), '')"


@query("extract_invoice", f"{with_tables('invoices')} SELECT document_id, {INVOICE_SQL} FROM invoices")
def extract_invoice(spark: SparkSession, base: str) -> DataFrame:
    df = derived.derive(spark, base, "invoices")
    return df.select("document_id", fields.invoice_fields(F.col("text")).alias("f")).select("document_id", "f.*")


@query(
    "extract_resume",
    f"""{with_tables('resumes')} SELECT document_id, {NAME} AS name,
array_to_string({EDUCATION}, '|') AS education, array_to_string({EXPERIENCE}, '|') AS experience FROM resumes""",
)
def extract_resume(spark: SparkSession, base: str) -> DataFrame:
    df = derived.derive(spark, base, "resumes")
    return df.select("document_id", fields.resume_fields(F.col("text")).alias("f")).select(
        "document_id",
        "f.name",
        F.array_join("f.education", "|").alias("education"),
        F.array_join("f.experience", "|").alias("experience"),
    )


@query(
    "extract_contract",
    f"""{with_tables('contracts')} SELECT document_id, {PARTY[0]} AS party_a, {PARTY[1]} AS party_b,
{first(fields.EFFECTIVE)} AS effective_date, {DURATION} AS duration FROM contracts""",
)
def extract_contract(spark: SparkSession, base: str) -> DataFrame:
    df = derived.derive(spark, base, "contracts")
    return df.select("document_id", fields.contract_fields(F.col("text")).alias("f")).select("document_id", "f.*")


ROUTED = ["invoices", "resumes", "contracts", "emails"]
SPECIFIC = "\nUNION ALL ".join(
    [
        *[
            f"SELECT document_id, 'invoice.{n}' AS entity_type, {first(p)} AS text FROM texts WHERE kind = 'invoice'"
            for n, p in fields.INVOICE.items()
        ],
        f"SELECT document_id, 'resume.name', {NAME} FROM texts WHERE kind = 'resume'",
        f"SELECT document_id, 'resume.education', unnest({EDUCATION}) FROM texts WHERE kind = 'resume'",
        f"SELECT document_id, 'resume.experience', unnest({EXPERIENCE}) FROM texts WHERE kind = 'resume'",
        f"SELECT document_id, 'contract.party_a', {PARTY[0]} FROM texts WHERE kind = 'contract'",
        f"SELECT document_id, 'contract.party_b', {PARTY[1]} FROM texts WHERE kind = 'contract'",
        f"SELECT document_id, 'contract.effective_date', {first(fields.EFFECTIVE)} FROM texts WHERE kind = 'contract'",
        f"SELECT document_id, 'contract.duration', {DURATION} FROM texts WHERE kind = 'contract'",
    ]
)


@query(
    "route_extractor",
    f"{with_tables(texts=ROUTED)} SELECT * FROM ({SPECIFIC}) WHERE text IS NOT NULL",
)
def route_extractor(spark: SparkSession, base: str) -> DataFrame:
    df = derived.texts(spark, base, ROUTED).withColumnRenamed("kind", "document_type")
    return ops.specific_rows(df)


@query(
    "union_entity_methods",
    f"""{with_tables(texts=ROUTED)}
SELECT document_id, entity_type, text, start_position, end_position, value, confidence, 'patterns' AS method FROM ({ALL_PATTERNS})
UNION ALL SELECT document_id, entity_type, text, NULL, NULL, NULL, NULL, 'document_specific' FROM ({SPECIFIC}) WHERE text IS NOT NULL""",
)
def union_entity_methods(spark: SparkSession, base: str) -> DataFrame:
    df = derived.texts(spark, base, ROUTED).withColumnRenamed("kind", "document_type")
    patterns = positions(ops.extract(df))
    specific = ops.specific_rows(df).withColumn("method", F.lit("document_specific"))
    return ops.union_methods(patterns, specific)


SEEN = "2024-02-15 00:00:00"


@query(
    "extract_all",
    f"""{with_tables(texts=ROUTED)}, e AS ({ALL_PATTERNS}),
v AS (SELECT * FROM e WHERE CASE entity_type WHEN 'email' THEN {EMAIL_OK} WHEN 'phone' THEN ({PHONE}) IS NOT NULL
  WHEN 'date' THEN {DATE} IS NOT NULL ELSE entity_type = 'currency' END),
r AS (SELECT document_id, 'patterns' AS part, entity_type, text, start_position, end_position, confidence, 'patterns' AS method FROM e
  UNION ALL SELECT document_id, 'validated', entity_type, text, start_position, end_position, confidence, 'patterns' FROM v
  UNION ALL SELECT document_id, 'document_specific', entity_type, text, NULL, NULL, NULL, 'document_specific' FROM ({SPECIFIC}) WHERE text IS NOT NULL)
SELECT t.document_id, t.kind AS document_type, epoch_us(TIMESTAMP '{SEEN}') AS seen_us, length(t.text)::INTEGER AS text_length, part, entity_type, r.text,
  start_position, end_position, confidence, method FROM texts t LEFT JOIN r USING (document_id)""",
)
def extract_all(spark: SparkSession, base: str) -> DataFrame:
    """Patterns, the valid ones among them, and the fields of the document's type, in one pass over the texts."""
    df = derived.texts(spark, base, ROUTED).withColumnRenamed("kind", "document_type")
    rows = positions(ops.all_rows(ops.extract_all(df, F.lit(SEEN).cast("timestamp"))))
    return rows.withColumn("seen_us", F.unix_micros("timestamp")).drop("timestamp")


NAMED = ["docs", "contracts", "cards", "emails"]
# Words and pairs of words that only blanks part; a name inside a longer one is left out.
TAGGED = rf"""e AS ({found('word', r'[\p{L}\p{N}_#]+', 1.0)}),
w AS (SELECT document_id, text, start_position, end_position, lead(text) OVER p AS next_text, lead(start_position) OVER p AS next_start,
  lead(end_position) OVER p AS next_end FROM e WINDOW p AS (PARTITION BY document_id ORDER BY start_position)),
c AS (SELECT document_id, text, start_position, end_position FROM e
  UNION ALL SELECT w.document_id, w.text || ' ' || next_text, start_position, next_end FROM w JOIN texts USING (document_id)
  WHERE regexp_full_match(substr(texts.text, end_position + 1, next_start - end_position), '\s+')),
m AS (SELECT c.*, label FROM c JOIN names ON c.text = names.name),
tagged AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.document_id = m.document_id AND o.start_position <= m.start_position
  AND o.end_position >= m.end_position AND o.end_position - o.start_position > m.end_position - m.start_position))"""


@query(
    "gazetteer_ner_join",
    rf"""{with_tables(texts=NAMED)}, names AS (
  SELECT c_name AS name, 'ORG' AS label FROM customer
  UNION ALL SELECT s_name, 'ORG' FROM supplier UNION ALL SELECT n_name, 'GPE' FROM nation),
{TAGGED}
SELECT document_id, text, label, start_position, end_position, 1.0::DOUBLE AS confidence, 'gazetteer' AS method FROM tagged""",
)
def gazetteer_ner_join(spark: SparkSession, base: str) -> DataFrame:
    names = (
        load(spark, base, "customer").select(F.col("c_name").alias("name"), F.lit("ORG").alias("label"))
        .unionByName(load(spark, base, "supplier").select(F.col("s_name").alias("name"), F.lit("ORG").alias("label")))
        .unionByName(load(spark, base, "nation").select(F.col("n_name").alias("name"), F.lit("GPE").alias("label")))
    )
    return positions(ops.gazetteer_entities(derived.texts(spark, base, NAMED), names))


@query(
    "service_entities",
    rf"""{with_tables(texts=NAMED)}, names AS (
  SELECT c_name AS name, 'ORG' AS label FROM customer UNION ALL SELECT s_name, 'ORG' FROM supplier),
{TAGGED}
SELECT document_id, label AS type, text AS mention_text, 1.0::DOUBLE AS confidence FROM tagged
UNION ALL SELECT document_id, entity_type, text, confidence FROM ({found('date', cols.PATTERNS['date'], 0.9)})
UNION ALL SELECT document_id, entity_type, text, confidence FROM ({found('url', cols.PATTERNS['url'], 0.9)})""",
)
def service_entities(spark: SparkSession, base: str) -> DataFrame:
    """What a document service returns: type, mention and confidence."""
    df = derived.texts(spark, base, NAMED)
    names = load(spark, base, "customer").select(F.col("c_name").alias("name"), F.lit("ORG").alias("label")).unionByName(
        load(spark, base, "supplier").select(F.col("s_name").alias("name"), F.lit("ORG").alias("label"))
    )
    tagged = ops.gazetteer_entities(df, names).select(
        "document_id", F.col("label").alias("type"), F.col("text").alias("mention_text"), "confidence"
    )
    matched = ops.extract(df, ["date", "url"]).select(
        "document_id", F.col("entity_type").alias("type"), F.col("text").alias("mention_text"), "confidence"
    )
    return tagged.unionByName(matched)


@query(
    "limit_first_match",
    f"""{TEXTS} SELECT document_id, {first(cols.PATTERNS['date'], 0)} AS first_date,
{first(fields.INVOICE['total'])} AS first_total FROM texts""",
)
def limit_first_match(spark: SparkSession, base: str) -> DataFrame:
    from docweave.functions.regex import first_group

    text = F.col("text")
    return derived.texts(spark, base).select(
        "document_id",
        first_group(text, cols.PATTERNS["date"], 0).alias("first_date"),
        first_group(text, fields.INVOICE["total"]).alias("first_total"),
    )
