"""Patterns looked for in batches, against Python ``re`` on each text alone."""

import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docweave.functions import entities as cols
from docweave.functions import matching
from docweave.operators import entities as ops

PARTS = (
    "12|555|1234|12345|123456789|4111111111111111|-| |  |/|2024|$|,|.|%|1.5%|@|@@|a.b@c.de|x.com|a|_|+|(|)|inv|Invoice |#|:|po|PURCHASE ORDER|"
    "tax|Tax ID|ein|vat|total|amount due|subtotal|discount|acct|account|routing|aba|é|٣|²|\n|\x1c|\0|￿|ſ|ı|İ|K|Σ|\U0001f600|://|http|httpſ://|HTTPS://|192.168.1.1|"
    "123-45-6789|?|=|&"
).split("|")


def made(seed, n=400):
    rng = random.Random(seed)
    return [None, "", "\0"] + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 50))) for _ in range(n)] + ["", None]


def wanted(text, registry, group=None):
    return [
        (name, m[0], m.start(), m.end(), m[group] if group else None)
        for name, pattern in registry.items()
        for m in re.finditer(pattern, text or "", re.IGNORECASE)
    ]


@pytest.mark.parametrize("size", [1, 100, matching.SLICE])
def test_batches_equal_python(monkeypatch, size):
    monkeypatch.setattr(matching, "SLICE", size)
    texts = made(size)
    column = pa.array(texts, pa.string())
    for registry, group, method in ((cols.PATTERNS, None, "patterns"), (cols.FINANCIAL, 1, "financial")):
        many = cols._many(registry, registry)
        found = matching.entities(column, many, group, 0.5, method).to_pylist()
        number = matching.counts(column, many).to_pylist()
        for text, spans, n in zip(texts, found, number, strict=True):
            want = wanted(text, registry, group)
            assert [(s["entity_type"], s["text"], s["start"], s["end"], s["value"]) for s in spans] == want
            assert {s["confidence"] for s in spans} <= {0.5} and {s["method"] for s in spans} <= {method}
            assert [(c["entity_type"], c["entities"]) for c in n] == [
                (name, k) for name in registry if (k := sum(w[0] == name for w in want))
            ]


def test_empty_batches():
    many = cols._many(cols.PATTERNS, cols.PATTERNS)
    for texts in ([], [None], ["", None]):
        assert matching.entities(pa.array(texts, pa.string()), many, None, 0.9, "patterns").to_pylist() == [[]] * len(texts)
        assert matching.counts(pa.array(texts, pa.string()), many).to_pylist() == [[]] * len(texts)


def test_flat_and_counted_entities(spark):
    """Rows typed by path, counted and summed up, from texts that are passed over once."""
    texts = made(5, 60)
    df = spark.createDataFrame(list(enumerate(texts)), "document_id long, text string").repartition(3)
    text = F.col("text")
    parts = {"patterns": cols.pattern_entities(text), "financial": cols.financial_entities(text)}
    flat = ops.flatten_entities(df, parts)
    plan = flat._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and "regexp" not in plan
    got = sorted((r.document_id, r.entity_type, r.text, r.start, r.end) for r in flat.collect())
    both = [(i, part, w) for i, t in enumerate(texts) for part, reg in (("patterns", cols.PATTERNS), ("financial", cols.FINANCIAL)) for w in wanted(t, reg)]
    assert got == sorted((i, f"{part}.{w[0]}", *w[1:4]) for i, part, w in both)
    summary = ops.entity_summary(ops.explode_entities(df, F.concat(*parts.values()))).collect()
    assert {r.document_id: (r.total_entities, r.entity_types, r.extraction_methods) for r in summary} == {
        i: (sum(b[0] == i for b in both), sorted({b[2][0] for b in both if b[0] == i}), sorted({b[1] for b in both if b[0] == i}))
        for i in {b[0] for b in both}
    }


def test_long_texts_stay_linear():
    texts = ["a." * 100_000 + "@", "@" * 100_000, "1." * 100_000, "12 " * 100_000, "po" * 100_000, "a@b." + "c" * 100_000 + "_"]
    many = cols._many(cols.PATTERNS, cols.PATTERNS)
    start = time.time()
    matching.entities(pa.array(texts), many, None, 0.9, "patterns")
    assert time.time() - start < 30


def test_many_short_texts():
    """Far less time than to try each expression at each sign (150 us a text of this length)."""
    line = "Invoice #INV-{0:010d}\nDate: 01/02/1997\nDue Date: 02/28/1998\nPurchase Order: PO-{0:010d}\nBill To: Customer#{0:09d}\nTotal: $1,{0}.50\nAccount: {0:06d}-0001"
    texts = pa.array([line.format(i) for i in range(100, 999)] * 10)
    many = cols._many(cols.PATTERNS, cols.PATTERNS)
    matching.counts(texts, many)
    start = time.process_time()
    matching.counts(texts, many)
    assert time.process_time() - start < 1.0


def test_flat_entities_need_no_function_of_each_entity(spark):
    df = spark.createDataFrame([(1, "tax 5 on 12/24/2024")], "document_id long, text string")
    flat = ops.flatten_entities(df, {"patterns": cols.pattern_entities(F.col("text")), "financial": cols.financial_entities(F.col("text"))})
    assert "lambda" not in flat._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.entity_type, r.text) for r in flat.collect()) == [("financial.tax_amount", "tax 5"), ("patterns.date", "12/24/2024")]


def test_predictions_clean_a_text_once(spark):
    from docweave.functions import classify
    from docweave.functions import text as prep
    from docweave.plans import predict

    df = spark.createDataFrame(list(enumerate(made(9, 40))), "document_id long, text string")
    done = predict.extract_and_predict(df).select("document_id", "text", "nlp_analysis.processed_tokens", "sentiment", "entity_count")
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[a-zA-Z") == 1 and "regexp_count" not in plan
    alone = df.select("document_id", F.size(prep.preprocess(F.col("text"))).alias("n"), classify.sentiment(F.col("text")).alias("s"))
    want = {r.document_id: (r.n, r.s) for r in alone.collect()}
    for r in done.collect():
        assert (r.processed_tokens, r.sentiment) == want[r.document_id]
        assert r.entity_count == len(wanted(r.text, cols.PATTERNS))


def test_workers_find_the_package_wherever_the_driver_runs(spark):
    import os

    import docweave
    from docweave.session import prepare

    root = os.path.dirname(os.path.dirname(docweave.__file__))
    for _ in range(2):
        paths = prepare(spark).sparkContext.environment["PYTHONPATH"].split(os.pathsep)
    assert paths.count(root) == 1
