"""Key phrases of blocks of texts against the plain formula."""

import math
import random
import re
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal

import pytest

from docweave.functions.text import STOP_WORDS
from docweave.operators import phrases, tfidf


def plain(rows, top=5):
    counts = {}
    for key, text in rows:
        words = [w for w in re.findall(r"\w{2,}", (text or "").lower()) if w not in STOP_WORDS]
        counts.setdefault(key, Counter()).update(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    held = Counter(t for c in counts.values() for t in c)
    out = set()
    for key, c in counts.items():
        score = {t: tf * (math.log((1 + len(rows)) / (1 + held[t])) + 1) for t, tf in c.items()}
        score = {t: float(Decimal(repr(s)).quantize(Decimal("1e-9"), ROUND_HALF_UP)) for t, s in score.items()}
        for rank, t in enumerate(sorted(score, key=lambda t: (-score[t], t))[:top], 1):
            out.add((key, rank, t, score[t]))
    return out


def made(seed, n=80):
    rng = random.Random(seed)
    pool = ["ab", "abc", "ab_", "zz", "Zebra", "über", "ÉCOLE", "日本", "x1", "the", "of", "q9", "\U00010400\U00010401", "a"]
    rows = [("n", None), ("e", ""), ("s", "the of a"), ("s", ""), (None, "lost words lost"), (None, None), ("d", "twin words"), ("d", "words twin twin"), ("d", "")]
    return rows + [(f"k{i}", " ".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))) for i in range(n)]


@pytest.mark.parametrize(("block", "part"), [(1, 3), (50, 40), (phrases.BLOCK, phrases.PART)])
@pytest.mark.parametrize("twice", [False, True])
def test_key_phrases_equal_the_formula(spark, monkeypatch, block, part, twice):
    monkeypatch.setattr(phrases, "BLOCK", block)
    monkeypatch.setattr(phrases, "PART", part)
    rows = made(block)
    if not twice:
        rows = list(dict(rows).items())
    df = spark.createDataFrame(rows, "document_id string, text string").repartition(3)
    got = {tuple(r) for r in tfidf.key_phrases(df).collect()}
    assert got == plain(rows)


def test_no_text_at_all(spark):
    for rows in ([], [("a", None), ("b", "the")]):
        assert tfidf.key_phrases(spark.createDataFrame(rows, "document_id string, text string")).count() == 0


def test_terms_are_not_shuffled_as_strings(spark):
    df = spark.createDataFrame(made(2), "document_id string, text string")
    plan = tfidf.key_phrases(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "hashpartitioning(term" not in plan
    # Only what may be among the best of a document leaves its block.
    rows = [(i, " ".join(f"word{i}x{k}" for k in range(300))) for i in range(20)]
    found, n = phrases.candidates(spark.createDataFrame(rows, "document_id long, text string"), "document_id", 5)
    assert n == 20 and found.count() == 100
