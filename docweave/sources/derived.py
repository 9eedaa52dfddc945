"""Inputs that Spark derives from the given tables.

The tables hold hardly any invoices, contracts, résumés, mails or recognised pages, so these are
rendered from them, one per row, by SQL that uses only functions every engine shares. Nothing is
random and nothing depends on the clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docweave.operators.logs import STEPS
from docweave.sources.tables import load, spread

NL = "chr(10)"
# 2024-01-01T00:00:00Z, the start of the derived calendars.
EPOCH_US = 1_704_067_200_000_000


def text(expr: str) -> str:
    return f"cast({expr} as string)"


def padded(expr: str, width: int) -> str:
    return f"lpad({text(expr)}, {width}, '0')"


def money(cents: str) -> str:
    """``1,234.56`` of an expression of whole cents (100 or more)."""
    s = text(cents)
    d = f"substr({s}, 1, length({s}) - 2)"
    return (
        f"(case when length({s}) > 8 then concat(substr({s}, 1, length({s}) - 8), ',', "
        f"substr({s}, length({s}) - 7, 3), ',', substr({s}, length({s}) - 4, 3)) "
        f"when length({s}) > 5 then concat(substr({s}, 1, length({s}) - 5), ',', "
        f"substr({s}, length({s}) - 4, 3)) else {d} end || '.' || right({s}, 2))"
    )


def lines(*parts: str) -> str:
    return "concat(" + f", {NL}, ".join(parts) + ")"


_CENTS = "cast(round(o_totalprice * 100) as bigint)"
_DAY = f"concat({padded('month(o_orderdate)', 2)}, '/', {padded('day(o_orderdate)', 2)}, '/', {text('year(o_orderdate)')})"
_DUE = f"concat({padded('month(o_orderdate) % 12 + 1', 2)}, '/28/', {text('year(o_orderdate) + 1')})"

INVOICES = f"""
select concat('inv-', {text('o_orderkey')}) as document_id, 'invoice' as kind, {lines(
    f"concat('Invoice #INV-', {padded('o_orderkey', 10)})",
    f"concat('Date: ', {_DAY})",
    f"concat('Due Date: ', {_DUE})",
    f"concat('Purchase Order: PO-', {padded('o_orderkey', 10)})",
    f"concat('Bill To: Customer#', {padded('o_custkey', 9)})",
    f"concat('Subtotal: $', {money(_CENTS)})",
    f"concat('Discount: $', {money(_CENTS + ' % 1000 + 100')})",
    f"concat('Tax: $', {money(_CENTS + ' % 9000 + 1000')})",
    f"concat('Tax ID: ', {text('o_orderkey % 90 + 10')}, '-', {padded('o_orderkey % 10000000', 7)})",
    f"concat('Total: $', {money(_CENTS)})",
    f"concat('Account: ', {padded('o_custkey', 6)}, '-', {padded('o_orderkey % 10000', 4)})",
    f"concat('Routing: ', {text('100000000 + o_orderkey % 899999999')})",
    f"concat('Payment terms: ', {text('o_orderkey % 9 + 1')}, '.5% within 30 days')",
)} as text from {{orders}}"""

CARDS = f"""
select concat('card-', {text('c_custkey')}) as document_id, 'card' as kind, {lines(
    f"concat('Name: ', c_name)",
    f"concat('Email: customer.', {text('c_custkey')}, '@nation', {text('c_nationkey')}, '.example.com')",
    f"concat('Phone: (', {text('c_custkey % 700 + 200')}, ') 555-', {padded('c_custkey % 10000', 4)})",
    f"concat('Mobile: 1-', {text('c_custkey % 600 + 300')}, '-555-', {padded('c_custkey % 10000', 4)})",
    f"concat('SSN: ', {text('c_custkey % 899 + 100')}, '-', {text('c_custkey % 90 + 10')}, '-', {padded('c_custkey % 10000', 4)})",
    f"concat('Card: 4111 ', {padded('(c_custkey * 7) % 10000', 4)}, ' ', {padded('(c_custkey * 11) % 10000', 4)}, ' ', {padded('c_custkey % 10000', 4)})",
    f"concat('Address: ', {text('c_custkey % 900 + 1')}, ' Main Street, Springfield ', {text('c_custkey % 90000 + 10000')})",
    f"concat('Web: https://www.example', {text('c_nationkey')}, '.com:8080/path/p_', {text('c_custkey')}, '?a=1&b=', {text('c_custkey')}, '#top')",
    f"concat('IP: 10.', {text('c_custkey % 256')}, '.', {text('(c_custkey * 3) % 256')}, '.', {text('(c_custkey * 7) % 256')})",
    f"concat('Birth: ', {text('c_custkey % 12 + 1')}, '/', {text('c_custkey % 31 + 1')}, '/', {text('1950 + c_custkey % 50')})",
    f"concat('Joined: 2020-', {padded('c_custkey % 12 + 1', 2)}, '-', {padded('c_custkey % 28 + 1', 2)})",
    f"concat('Limit: $', {money('cast(round(abs(c_acctbal) * 100) as bigint) + 100')}, ' spare $,')",
)} as text from {{customer}}"""

RESUMES = f"""
select concat('res-', {text('c_custkey')}) as document_id, 'resume' as kind, {lines(
    "'  '",
    f"concat('  Applicant ', {text('c_custkey')}, ' ')",
    "'Education'",
    f"concat(case c_custkey % 3 when 0 then 'Bachelor' when 1 then 'Master' else 'PhD' end, ' of Arts, ', {text('1990 + c_custkey % 30')})",
    "case when c_custkey % 2 = 0 then 'Certificate in writing' else 'No other degree' end",
    "'Experience'",
    "concat('Senior ', case c_custkey % 4 when 0 then 'Engineer' when 1 then 'Manager' when 2 then 'Analyst' else 'Painter' end, '; 2015')",
    "case when c_custkey % 5 = 0 then 'Data Consultant, 2019' else 'Other work, 2019' end",
    "'Skills'",
    "concat('Qualifications in ', lower(c_mktsegment))",
)} as text from {{customer}}"""

CONTRACTS = f"""
select concat('con-', {text('c_custkey')}) as document_id, 'contract' as kind, {lines(
    "'Agreement'",
    f"case when c_custkey % 3 = 0 then concat('The party \"Supplier ', {text('c_custkey % 97')}, '\" and \"', c_name, '\" sign below.') "
    f"else concat('Made between Supplier#', {padded('c_custkey % 97', 9)}, ' and ', c_name, ' hereby, under the terms and conditions here.') end",
    f"concat('Effective Date: ', {padded('c_custkey % 12 + 1', 2)}, '/', {padded('c_custkey % 28 + 1', 2)}, '/', {text('2000 + c_custkey % 24')})",
    f"concat('Term: it runs for ', {text('c_custkey % 9 + 1')}, case c_custkey % 3 when 0 then ' years' when 1 then ' months' else ' days' end)",
    "'Signature of both parties'",
)} as text from {{customer}}"""

EMAILS = f"""
select concat('mail-', {text('conv_id')}, '-', {text('turn')}) as document_id, 'email' as kind, {lines(
    f"concat('From: ', role, '.', {text('conv_id')}, '@example.com')",
    f"concat('To: reader.', {text('turn')}, '@example.com')",
    f"concat('Subject: turn ', {text('turn')})",
    "'Dear reader,'",
    "text",
    "'Sincerely'",
)} as text from {{conversations}}"""

DOCUMENTS = f"""
select concat('doc-', {text('doc_id')}) as document_id, 'document' as kind, text from {{documents}}"""

STEP_LOGS = f"""
select cast((event_id - event_id % {len(STEPS)}) / {len(STEPS)} as bigint) as document_id,
  case event_id % {len(STEPS)} {' '.join(f"when {i} then '{s}'" for i, s in enumerate(STEPS))} end as step,
  event_type <> 'error' as success, value as duration, ts as timestamp from {{events}}"""

FILES = f"""
select concat('documents/', {text('doc_id')}, case doc_id % 4 when 0 then '.txt' when 1 then '.pdf' when 2 then '.PNG' else '.exe' end) as name,
  n_chars * case when doc_id % 50 = 0 then 5000 else 1 end as size,
  {EPOCH_US} + (doc_id * 7919 % 86400) * 60000000 as created_us from {{documents}}
union all
select concat('processed/', {text('doc_id')}, '_results.json') as name, n_chars * 2 as size,
  {EPOCH_US} + (doc_id * 7919 % 86400) * 60000000 + 3600000000 as created_us from {{documents}} where doc_id % 3 <> 0
union all
select concat('pages/', {text('page_id')}, '.html') as name, cast(length(html) as bigint) as size,
  {EPOCH_US} + (page_id * 104729 % 86400) * 60000000 as created_us from {{pages}}"""

# Columns that spread an input over the cores before the row work starts.
KEYS = {
    "orders": ["o_orderkey"],
    "customer": ["c_custkey"],
    "conversations": ["conv_id", "turn"],
    "documents": ["doc_id"],
    "events": ["event_id"],
    "pages": ["page_id"],
}
TABLES = {
    "invoices": (INVOICES, ["orders"]),
    "cards": (CARDS, ["customer"]),
    "resumes": (RESUMES, ["customer"]),
    "contracts": (CONTRACTS, ["customer"]),
    "emails": (EMAILS, ["conversations"]),
    "docs": (DOCUMENTS, ["documents"]),
    "step_logs": (STEP_LOGS, ["events"]),
    "files": (FILES, ["documents", "pages"]),
}
# What the extractors and the classifier are given.
TEXTS = ["docs", "invoices", "cards"]
TYPED = ["docs", "invoices", "resumes", "contracts", "emails"]

# Two recognitions of every page of 2,000 characters.
PAGE_CHARS = 2000
OCR_COLUMNS = f"""
  'tesseract' as engine, cast((document_id * 37 + page * 11) % 101 as double) as confidence,
  case when (document_id + page) % 17 = 0 then '' else substr(text, (page - 1) * {PAGE_CHARS} + 1, {PAGE_CHARS}) end as text"""
VISION_COLUMNS = f"""
  'google_vision' as engine, (document_id * 53 + page * 29) % 101 / cast(100 as double) as confidence,
  case when (document_id + page) % 13 = 0 then '' else concat('> ', substr(text, (page - 1) * {PAGE_CHARS} + 1, {PAGE_CHARS})) end as text"""


def source(spark: SparkSession, base: str, table: str) -> DataFrame:
    """A table, dealt out by key."""
    return spread(load(spark, base, table), *KEYS[table])


def derive(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A derived table by name."""
    query, needs = TABLES[name]
    return spark.sql(query, **{t: source(spark, base, t) for t in needs})


def texts(spark: SparkSession, base: str, names: list[str] = TEXTS) -> DataFrame:
    """``(document_id, kind, text)`` of several derived tables."""
    out = derive(spark, base, names[0])
    for name in names[1:]:
        out = out.unionByName(derive(spark, base, name))
    return out


def ocr_pages(spark: SparkSession, base: str) -> DataFrame:
    """``(document_id, page, engine, text, confidence)`` for every page and engine."""
    paged = spark.sql(
        f"""select doc_id as document_id, text, explode(sequence(1,
        greatest(1, cast(ceil(length(text) / {PAGE_CHARS}.0D) as int)))) as page from {{documents}}""",
        documents=source(spark, base, "documents"),
    )
    return spark.sql(
        f"""select document_id, page, {OCR_COLUMNS} from {{paged}}
        union all select document_id, page, {VISION_COLUMNS} from {{paged}}""",
        paged=paged,
    )


def requests(spark: SparkSession, base: str) -> DataFrame:
    """``(event_id, client_id, ts)``: the events as requests of their users."""
    from pyspark.sql import functions as F

    return load(spark, base, "events").select("event_id", F.col("user_id").alias("client_id"), "ts")
