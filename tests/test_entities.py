"""Extraction against Python ``re``, on edge texts and random ones."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docweave.functions import entities as cols
from docweave.functions import fields, validate
from docweave.operators import entities as ops

EDGES = [
    None,
    "",
    "   \n ",
    "Invoice #INV-7 dated 2024-01-15 total $1,250.00 contact a.b@example.com",
    "é555-123-4567 x@y.com a@b.co|m \U0001f600 call 555 123 4567 or +1-555-123-4567",
    "$1,200.50 $, 12.5% 02/30/2024 13/05/2024 192.168.1.1 12345-6789",
    "https://a-b.com:80/x/y?z=1#q and http://Ünï.example/ä",
    "²12345 ١٢٣-٤٥-٦٧٨٩ Invoice # INV-1 po: 77 EIN 12-3456789 123-45-6789\x1c",
    "In total, nothing. Subtotal $5. Tax: 3 TAX ID: 12-3456789 ınv 55 ACCT 9 diſcount 4",
    "12 cats stand here 12 Main Street, Springfield 12345 and 5 Elm Ave.",
    "marks ￿ 555-123-4567 ￿ 12 Main St x@y.org total 5",
    "5551234567 " * 300,
]


def random_texts(n):
    rng = random.Random(7)
    parts = (
        "12|555|-| |  |/|2024|$|,|.|%|@|x.com|Main|Street|st|Pl|inv|invoice|#|:|po|tax|total|é|٣|²|\n|\x1c|ſ|(|)|+|_|a".split("|")
    )
    return ["".join(rng.choice(parts) for _ in range(rng.randint(3, 40))) for _ in range(1500)]


def expected(texts):
    out = {}
    for i, text in enumerate(texts):
        for reg, group in ((cols.PATTERNS, 0), (cols.FINANCIAL, 1), ({"address": cols.ADDRESS}, 0)):
            for name, pattern in reg.items():
                for m in re.finditer(pattern, text or "", re.IGNORECASE):
                    shown = m.group().strip() if name == "address" else m.group()
                    value = m.group(1) if group else None
                    out.setdefault((i, name), []).append((shown, m.start(), m.end(), value))
    return out


def test_every_pattern_equals_python(spark):
    texts = EDGES + random_texts(1500)
    df = spark.createDataFrame(list(enumerate(texts)), "document_id long, text string").repartition(4)
    text = F.col("text")
    spans = F.concat(cols.pattern_entities(text), cols.financial_entities(text), cols.address_entities(text))
    found = {}
    for r in ops.explode_entities(df, spans).collect():
        found.setdefault((r.document_id, r.entity_type), []).append((r.text, r.start, r.end, r.value))
    want = expected(texts)
    assert {k for k, _ in want} and found == want


def test_offsets_point_at_the_match(spark):
    df = spark.createDataFrame(list(enumerate(EDGES)), "document_id long, text string")
    rows = ops.extract(df).join(df.withColumnRenamed("text", "whole"), "document_id")
    off = rows.where(F.col("text") != F.expr("substring(whole, start + 1, end - start)"))
    assert off.count() == 0


def test_long_texts_stay_linear(spark):
    """Thousands of matches and of digits without an address must not take minutes."""
    import time

    texts = ["5551234567 " * 20_000, "12 and 34 " * 50_000, "3" * 100_000 + " %", "invoice" + " " * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "document_id long, text string")
    start = time.time()
    n = ops.explode_entities(
        df,
        F.concat(
            cols.pattern_entities(F.col("text"), ["phone", "percentage", "invoice_number"]),
            cols.address_entities(F.col("text")),
        ),
    ).count()
    # Thirteen digits a phone number in the run of threes, and "inv" followed by "oice".
    assert n == 20_000 + 100_000 // 13 + 1
    assert time.time() - start < 60


def test_own_pattern_under_a_known_name(spark):
    df = spark.createDataFrame([(1, "cost 5 EUR")], "document_id long, text string")
    got = ops.extract(df, registry={"currency": r"\d+ EUR"}).collect()
    assert [(r.text, r.start) for r in got] == [("5 EUR", 5)]


@pytest.mark.parametrize(
    ("value", "iso"),
    [
        ("01/15/2024", "2024-01-15"),
        ("13/05/2024", "2024-05-13"),
        ("02/30/2024", None),
        ("2024-1-5", "2024-01-05"),
        ("1-5-2024", "2024-01-05"),
        ("2024/02/29", "2024-02-29"),
        ("nonsense", None),
    ],
)
def test_dates(spark, value, iso):
    got = spark.range(1).select(validate.parsed_date(F.lit(value)).cast("string")).first()[0]
    assert got == iso


def test_phones_money_and_mail(spark):
    df = spark.createDataFrame(
        [("555.123.4567", "$1,250.", "a@b.co|m"), ("1 (555) 123-4567", "$,", "a@b.com"), ("12345", "", "A@B")],
        "phone string, money string, mail string",
    )
    got = df.select(
        validate.normalized_phone(F.col("phone")), validate.clean_currency(F.col("money")), validate.valid_email(F.col("mail"))
    ).collect()
    assert [tuple(r) for r in got] == [
        ("(555) 123-4567", 1250.0, False),
        ("1-(555) 123-4567", 0.0, True),
        (None, 0.0, False),
    ]


def test_resume_and_contract_equal_python(spark):
    texts = [
        "\n  Jo Doe \nEducation\nBachelor of Arts 2010\nMaster\nSkills x\nExperience\nSenior Engineer; Data Analyst\n",
        "no sections at all",
        "EXPERIENCE lead developer EDUCATION phd 1999",
        "made between A Ltd and B\nCo hereby agree. Effective date: 1/2/2024 Term of 2 years",
        'party "X" and "Y" agree; term\nis 3 months',
        "between A and B agree, effective 01-02-2024, term: 10day",
        "Experience: engineer manager; analyst. Lead developer at X\nconsultant and then specialist work, coordinator",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    rows = df.select(
        "i", fields.resume_fields(F.col("text")).alias("r"), fields.contract_fields(F.col("text")).alias("c")
    ).orderBy("i").collect()
    for text, row in zip(texts, rows, strict=True):
        section = re.search(fields.EDUCATION, text, re.S)
        assert row.r.education == (re.findall(fields.DEGREE, section.group(1)) if section else [])
        section = re.search(fields.EXPERIENCE, text, re.S)
        assert row.r.experience == (re.findall(fields.JOB, section.group(1)) if section else [])
        assert row.r.name == next(s.strip() for s in text.split("\n") if s.strip())
        hits = [m for m in (re.search(p, text) for p in fields.PARTIES) if m]
        assert (row.c.party_a, row.c.party_b) == ((hits[0][1].strip(), hits[0][2].strip()) if hits else (None, None))
        term = re.search(fields.TERM, text)
        assert row.c.duration == (f"{term[1]} {term[2]}" if term else None)


def plain_names(text, names):
    words = [(m[0], m.start(), m.end()) for m in re.finditer(r"[\w#]+", text or "")]
    found = []
    for i in range(len(words)):
        for j in range(i, len(words)):
            if j > i and not re.fullmatch(r"\s+", text[words[j - 1][2] : words[j][1]]):
                break
            name = " ".join(w for w, _, _ in words[i : j + 1])
            found += [(name, label, words[i][1], words[j][2]) for n, label in names if n == name]
    inside = lambda f: any(o[2] <= f[2] and o[3] >= f[3] and o[3] - o[2] > f[3] - f[2] for o in found)
    return [f for f in found if not inside(f)]


def test_names_of_a_dictionary(spark):
    names = [("New", "A"), ("New York", "B"), ("New York City Hall", "C"), ("York", "D"), ("City", "E"), ("C#", "F"), ("York", "G"), ("Ünï", "H"), ("a b c", "I"), ("b", "J")]
    rng = random.Random(4)
    pool = ["New", "York", "City", "Hall", "C#", "a", "b", "c", "Ünï", "and", "é\U0001f600"]
    texts = [None, "", "new york", "New York City Hall and New\n\tYork  City", "New, York", "xNew New_York C# C", "New York City Hal"]
    texts += ["".join(rng.choice(pool) + rng.choice([" ", " ", "  ", ", ", "\n", "\x1c", ". "]) for _ in range(30)) for _ in range(40)]
    rows = list(enumerate(texts))
    got = ops.gazetteer_entities(spark.createDataFrame(rows, "document_id long, text string"), spark.createDataFrame(names, "name string, label string"))
    want = [(i, *f) for i, t in rows for f in plain_names(t, names)]
    assert sorted(map(tuple, got.select("document_id", "text", "label", "start", "end").collect())) == sorted(want)
    none = ops.gazetteer_entities(spark.createDataFrame(rows, "document_id long, text string"), spark.createDataFrame([], "name string, label string"))
    assert none.count() == 0


def test_offsets_of_few_and_of_many_matches(spark):
    """Both ways of placing matches, at the number where one gives way to the other."""
    for n in (1, 20, 62, 63, 64, 65, 300):
        text = "é\U0001f600 " + " x ".join(f"${i},00.5" for i in range(n)) + " call (555) 123-4567 or +1 555.123.4567"
        row = spark.createDataFrame([(text,)], "text string").select(
            cols.pattern_entities(F.col("text"), ["currency", "phone"]).alias("e"),
            cols.find_spans(F.col("text"), r"\$(\d+),", 1).alias("v"),
        ).first()
        expected = [(k, m.group(), m.start(), m.end()) for k in ("currency", "phone") for m in re.finditer(cols.PATTERNS[k], text)]
        assert [(e.entity_type, e.text, e.start, e.end) for e in row.e] == expected
        assert [(v.text, v.start, v.end, v.value) for v in row.v] == [
            (m.group(), m.start(), m.end(), m.group(1)) for m in re.finditer(r"\$(\d+),", text)
        ]


def test_patterns_with_digits_are_not_tried_on_texts_without(spark):
    from pyspark.sql import functions as F

    from docweave.functions.entities import REQUIRED_DIGIT, pattern_entities
    from docweave.functions.fields import INVOICE, invoice_fields
    from docweave.functions.regex import first_group

    assert "rlike" in str(pattern_entities(F.col("t"), ["phone"])).lower() and REQUIRED_DIGIT >= {"phone", "zip_code"}
    texts = ["no digits", "٤٥٦ ٤٥٦ ٤٥٦٧", "INVOİCE 4, ınvoice #A1, DUE DATE: 1/2/2020", "TOTAL: $5 Update 01/02/2023", "bıll", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.select(F.size(pattern_entities(F.col("t"), ["phone"]))).collect()[1][0] == 1
    plain = F.struct(*[first_group(F.col("t"), p).alias(n) for n, p in INVOICE.items()])
    assert all(r.a == r.b for r in df.select(invoice_fields(F.col("t")).alias("a"), plain.alias("b")).collect())
