"""Filter audit against a plain walk over every order."""

import re
from collections import Counter
from itertools import permutations

from hypothesis import given
from hypothesis import strategies as st

from docweave.llm import audit
from tests.llm.conftest import PROSE, rows

LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, 1, 1), (8, None, 1), (None, 1, 1), (12, 1, 1), (99, 1, 1)]


def plain_fails(row, table):
    text = row.text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = set()
    if len(words) < 50:
        fails.add("A")
    if 100 * len(set(words)) < 65 * len(words):
        fails.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
        fails.add("C")
    if re.search(r"[#$%&*|]", text):
        fails.add("D")
    if row.doc_id is not None and any(o.doc_id is not None and o.doc_id < row.doc_id and (o.text or "") == text for o in table):
        fails.add("E")
    return fails


def plain(table, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    out = {}
    for part in {r.source or "" for r in table}:
        mine = [(r.doc_id, plain_fails(r, table)) for r in table if (r.source or "") == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                here = [d for d in left if f in d[1]]
                gone = sum(f in d[1] for d in mine) - len(here)
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(here)
                labelled = [sum(d[0] is not None and d[0] in s for d in here) for s in (good, toxic)]
                out[part, order, step] = [len(left), len(here), gone, sum(d[1] == {f} for d in mine), *labelled]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return sorted(((*k, *v) for k, v in out.items()), key=repr)


def test_audit(spark, docs, crowded, empty):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    more = spark.createDataFrame([(20 + i, PROSE, "en", "hot", 1) for i in range(30)] + [(60, "ALL CAPS # HERE " * 30, "en", "a", 1)], docs.schema)
    table = docs.union(more)
    want = plain(table.collect(), LABELS)
    assert rows(audit.audit(table, labels)) == want
    assert rows(audit.audit(crowded, labels.withColumn("part", labels.doc_id))) == plain(docs.collect(), LABELS)
    assert audit.audit(empty, labels).count() == 0
    assert [r[7:9] for r in rows(audit.audit(docs, labels.where("false")))] == [(0, 0)] * 120 * 5 * 4


def test_many_parts(spark, docs):
    """More parts than a task holds at a time, and salts that meet in the second round."""
    table = spark.range(0, 40, numPartitions=7).selectExpr("id AS doc_id", "cast(id AS string) AS text", "'en' AS lang", "cast(id % 9 AS string) AS source")
    labels = docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    assert rows(audit.audit(table, labels, parts=2)) == plain(table.collect(), [(r.doc_id, 1, 0) for r in docs.collect()])


@given(st.dictionaries(st.integers(0, 127), st.integers(1, 2**62 // 128), max_size=40))
def test_fields_never_overflow(counts):
    total = sum(n * audit.wide(code) for code, n in counts.items())
    fields = audit.unpack(total)
    want = sum((n * audit.unpack(audit.wide(code)) for code, n in counts.items()), audit.unpack(0))
    assert (fields == want).all()
    assert (fields[..., 0] + fields[..., 1].cumsum(1) == sum(counts.values())).all()
