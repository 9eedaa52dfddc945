"""Operators on documents against plain Python."""

import collections
import hashlib
import math
import random
import re
import string
import time
import zlib
from array import array

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docweave.llm import graph, neardup, packing, pii, quality, sampling, tokenfiles, tokens, toxicity, wordmodel
from docweave.llm import words as W
from docweave.llm.store import keep, new_path, ready
from tests.llm.conftest import COLUMNS, LONG, ROWS, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


# 1 quality rules -----------------------------------------------------------------------------------


def base_features(text):
    words = WORD.findall(text or "")
    at = collections.defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    repeated = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated))


def test_quality_features_and_limits(docs, crowded, empty):
    got = quality.judge(docs).collect()
    assert len(got) == len(ROWS)
    want = collections.Counter((r[0], base_features(r[1])) for r in ROWS)
    assert collections.Counter((r.doc_id, tuple(r[1:6])) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert rows(quality.judge(crowded)) == rows(quality.judge(docs))
    assert quality.judge(empty).count() == 0


def test_perplexity_against_a_plain_model(spark):
    texts = ["abab abba", "baab", "Abc, abc.", "", "zz"]
    df = spark.createDataFrame([(i, t, "en", None, 0) for i, t in enumerate(texts)], COLUMNS)
    model = quality.estimate(quality.count(df), 5)
    table, order = quality.classes(), quality.ORDER
    grams = collections.Counter()
    for t in texts:
        s = [29] * (order - 1) + [int(table[ord(c)]) for c in t]
        grams.update(tuple(s[i : i + order]) for i in range(len(t)))
    counts = {order: grams}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / 32
        c = counts[k]
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d = [0.0] + [min(max(j - (j + 1) * y * n[j] / n[j - 1] if n[j - 1] else j * 0.5, 0.05), j - 0.05) for j in (1, 2, 3)]
        same = {x: v for x, v in c.items() if x[:-1] == g[:-1]}
        total = sum(same.values())
        if not total:
            return p(g[1:])
        off = sum(d[min(v, 3)] for v in same.values()) / total
        v = same.get(g, 0)
        return max(v - d[min(v, 3)], 0) / total + off * p(g[1:])

    for g in [*grams, (0, 1, 2, 3), (29, 29, 0, 25), (5, 5, 5, 5), (0, 1, 0, 25)]:
        code = np.array([sum(x << 5 * (order - 1 - i) for i, x in enumerate(g))])
        assert math.isclose(model.log_probabilities(1, code)[0], math.log(p(g)), rel_tol=1e-5)


def test_junk_leaves_the_band(spark):
    rng = np.random.default_rng(1)
    known = ["".join(rng.choice(list("aeiou") if k % 2 else list("bdlmnrst"), 1)[0] for k in range(n)) for n in rng.integers(2, 9, 400)]
    prose = [" ".join(rng.choice(known, int(n))) + "." for n in rng.integers(150, 400, 60)]
    junk = [" ".join(f"{w}%%%@@" for w in rng.choice(known, 200)), " ".join(rng.permutation(list("qxzjkvwy" * 40))).replace(" ", "q ")]
    df = spark.createDataFrame([(i, t, "en", None, 0) for i, t in enumerate([*prose, *junk])], COLUMNS)
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert not got[60].base_failed and not got[60].kept and not got[61].kept
    assert sum(got[i].kept for i in range(60)) >= 57


def test_word_perplexity_against_a_plain_model(spark):
    """Every word n-gram counts, and a text is judged by the model of all others."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{int(k)}" for k in rng.zipf(1.5, int(n)) % 40) for n in rng.integers(1, 60, 12)]
    texts += [texts[0], "W1 w1 w1", " ", None]
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "text_key long, model int, text string")
    df = df.withColumn("text_key", F.xxhash64("text"))
    keys = {r.text: r.text_key for r in df.collect()}
    got = {r.text_key: r.word_perplexity for r in wordmodel.perplexity(df, 2).collect()}
    assert len(got) == len({t for t in texts if t and t.strip()})

    def tables(some):
        c3 = collections.Counter()
        for t in some:
            w = ["<s>", "<s>", *WORD.findall(t or "")]
            c3.update(zip(w, w[1:], w[2:]))
        c2 = collections.Counter(g[1:] for g in c3)
        return [collections.Counter(g[1:] for g in c2), c2, c3]

    d = [wordmodel.discounts(*(sum(v == i for v in c.values()) for i in (1, 2, 3, 4))) for c in tables(texts)]
    for text, key in keys.items():
        if key not in got:
            continue
        c = tables(t for t in texts if t != text)

        def p(g):
            k = len(g)
            if not k:
                return 1 / (len(c[0]) + 1)
            same = {x: v for x, v in c[k - 1].items() if x[:-1] == g[:-1]}
            total = sum(same.values())
            if not total:
                return p(g[1:])
            off = sum(d[k - 1][min(v, 3)] for v in same.values()) / total
            v = same.get(g, 0)
            return (v - d[k - 1][min(v, 3)]) / total + off * p(g[1:])

        w = ["<s>", "<s>", *WORD.findall(text)]
        want = -sum(math.log(p(g)) for g in zip(w, w[1:], w[2:])) / (len(w) - 2)
        assert math.isclose(got[key], want, rel_tol=1e-9)


def test_word_perplexity_without_the_texts_group(spark):
    """Every text of a group teaches the model and is scored for itself, by the model of all other groups."""
    rng = np.random.default_rng(4)
    some = lambda n: [f"w{int(k)}" for k in rng.zipf(1.5, int(n)) % 40]
    made = [(1 + i, " ".join(some(n))) for i, n in enumerate(rng.integers(1, 60, 9))]
    for head in (20, 21):
        first = some(50)
        made += [(head, " ".join(w if rng.random() < 0.9 else "new" for w in first)) for _ in range(4)]
    made += [made[-1], (30, ""), (30, "w1 w2 w1 w2")]
    df = spark.createDataFrame([(h, h % 2, t) for h, t in made], "head long, model int, text string")
    df = df.withColumn("text_key", F.xxhash64("text")).withColumn("alone", F.col("head") < 20)
    keys = {r.text: r.text_key for r in df.collect()}
    got = {r.text_key: r.word_perplexity for r in wordmodel.perplexity(df, 2).collect()}
    assert len(got) == len({t for _, t in made if t})

    def tables(some):
        c3 = collections.Counter()
        for t in some:
            w = ["<s>", "<s>", *t.split()]
            c3.update(zip(w, w[1:], w[2:]))
        c2 = collections.Counter(g[1:] for g in c3)
        return [collections.Counter(g[1:] for g in c2), c2, c3]

    for head, text in made:
        if not text:
            continue
        d = [wordmodel.discounts(*(sum(v == i for v in c.values()) for i in (1, 2, 3, 4))) for c in tables(t for h, t in made if h % 2 == head % 2)]
        c = tables(t for h, t in made if h % 2 == head % 2 and h != head)

        def p(g):
            k = len(g)
            if not k:
                return 1 / (len(c[0]) + 1)
            same = {x: v for x, v in c[k - 1].items() if x[:-1] == g[:-1]}
            total = sum(same.values())
            if not total:
                return p(g[1:])
            off = sum(d[k - 1][min(v, 3)] for v in same.values()) / total
            v = same.get(g, 0)
            return (v - d[k - 1][min(v, 3)]) / total + off * p(g[1:])

        w = ["<s>", "<s>", *text.split()]
        want = -sum(math.log(p(g)) for g in zip(w, w[1:], w[2:])) / (len(w) - 2)
        assert math.isclose(got[keys[text]], want, rel_tol=1e-6), (head, text)


def test_kept_tables_leave_no_shuffle_files(spark, docs):
    """What a kept table has shuffled goes with its write, not with the driver's next collection of garbage."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        every = disk.getAllFiles()
        return {n for n in (every.apply(i).getName() for i in range(every.size())) if n.startswith("shuffle_")}

    ready(spark)
    before = files()
    made = keep(docs.groupBy("lang").count(), "test-tidy")
    for _ in range(100):
        left = files() - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and "lang" in made.columns


def test_facts_of_ngrams_are_worked_out_once(spark, monkeypatch):
    """Texts alone and groups read the same table of facts; the counts it comes from are not read again."""
    read = []

    def noted(df, name):
        read.append((name, {f.split("/llm/")[1].rsplit("-", 1)[0] for f in df.inputFiles() if "/llm/" in f}))
        return keep(df, name)

    monkeypatch.setattr(wordmodel, "keep", noted)
    made = [(1, "a b c d a b"), (2, "b c d e"), (5, "a b c x"), (5, "a b c y")]
    df = spark.createDataFrame([(h, 1, t, h < 5) for h, t in made], "head long, model int, text string, alone boolean")
    assert wordmodel.perplexity(df.withColumn("text_key", F.xxhash64("text")), 2).count() == 4
    names = [name for name, _ in read]
    after = read[names.index("words-facts") + 1 :]
    assert names.count("words-facts") == 1 and len(after) > 2
    assert not any(f.startswith(("words-1", "words-2", "words-3")) for _, files in after for f in files)


def test_ngrams_are_no_rows(spark, monkeypatch):
    """What is kept on the way has rows for blocks and parts, far fewer than there are n-grams."""
    kept = []

    def noted(df, name):
        kept.append(keep(df, name))
        most.append(kept[-1].count())
        return kept[-1]

    most = []
    monkeypatch.setattr(wordmodel, "keep", noted)
    rng = random.Random(9)
    made = [(i, 1, " ".join(f"w{rng.randrange(300)}" for _ in range(400))) for i in range(6)]
    df = spark.createDataFrame(made, "text_key long, model int, text string")
    assert wordmodel.perplexity(df, 2).count() == 6
    assert max(most) < 400


def test_word_perplexity_in_many_blocks(spark, monkeypatch):
    """Small blocks, slices, parts, and groups that lie in several blocks change nothing."""
    rng = np.random.default_rng(7)
    some = lambda n: [f"w{int(k)}" for k in rng.zipf(1.5, int(n)) % 40]
    made = [(1 + i, " ".join(some(n))) for i, n in enumerate(rng.integers(1, 60, 9))]
    for head, n in ((20, 6), (21, 2), (23, 3)):
        first = some(40)
        made += [(head, " ".join(w if rng.random() < 0.9 else f"new{i}" for w in first)) for i in range(n)]
    made += [made[-1], made[0], (30, ""), (31, "w1")]
    df = spark.createDataFrame([(h, h % 2, t) for h, t in made], "head long, model int, text string")
    df = df.withColumn("text_key", F.xxhash64("text")).withColumn("alone", F.col("head") < 20)
    want = {r.text_key: r.word_perplexity for r in wordmodel.perplexity(df, 2).collect()}
    for name, value in (("BLOCK", 50), ("SPREAD", 100), ("PART", 16), ("SMALL", 0), ("SLICES", 3), ("SUBSETS", 2)):
        monkeypatch.setattr(wordmodel, name, value)
    got = {r.text_key: r.word_perplexity for r in wordmodel.perplexity(df, 2).collect()}
    assert len(got) == len({t for _, t in made if t}) and got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-6) for k in want)


def test_near_copies_have_a_verdict_of_their_own(spark):
    """Texts that share most of their words are scored one by one."""
    rng = random.Random(8)
    pool = [f"{a}{b}" for a in "ka lo mi ne ru so ti va".split() for b in "ben dor fin gal hum jos".split()]
    made = [" ".join(rng.choice(pool) for _ in range(80)) for _ in range(12)]
    made += [made[0].replace(pool[3], "unseen"), made[0] + " and one unseen end"]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(made)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.log_perplexity for r in quality.judge(df).collect()}
    assert len({got[i] for i in (0, 12, 13)}) == 3


def test_word_salad_leaves_the_band(spark):
    """Ordinary words in no order are spelled well; only a model of words can tell them."""
    rng = np.random.default_rng(5)
    known = ["".join(rng.choice(list("aeiou" if k % 2 else "bdlmnrst")) for k in range(n)) for n in rng.integers(3, 9, 600)]
    follow = rng.integers(0, 600, (600, 2))
    def walk(n):
        at, out = int(rng.integers(600)), []
        for _ in range(n):
            out.append(known[at])
            at = int(follow[at, rng.integers(2)])
        return out
    prose = [walk(300) for _ in range(80)]
    salad = [list(rng.permutation(walk(300))) for _ in range(3)]
    df = spark.createDataFrame([(i, " ".join(t), "en", None, 0) for i, t in enumerate([*prose, *salad])], COLUMNS)
    got = {r.doc_id: r for r in quality.judge(df).collect()}
    assert not any(got[80 + i].kept or got[80 + i].base_failed for i in range(3))
    assert sum(got[i].kept for i in range(80)) >= 76


def test_near_copies_of_good_texts_stay(spark):
    """Texts whose twins differ in one word of twenty are not known by heart."""
    rng = random.Random(6)
    pool = [f"{a}{b}" for a in "ka lo mi ne ru so ti va".split() for b in "ben dor fin gal hum jos ken lim mor nal".split()]
    text = lambda: [rng.choice(pool[: rng.choice([8, 30, 80])]) for _ in range(rng.randint(90, 200))]
    made, groups = [(i, " ".join(text())) for i in range(120)], {}
    for g in range(8):
        first = text()
        for _ in range(rng.choice([2, 5])):
            words = [rng.choice(pool) if rng.random() < 0.05 else w for w in first]
            groups.setdefault(g, []).append(len(made))
            made.append((len(made), " ".join(words)))
    df = spark.createDataFrame([(i, t, "en") for i, t in made], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality.judge(df).where("kept").collect()}
    assert len(kept) >= 0.9 * len(made)
    assert all(any(i in kept for i in ids) for ids in groups.values())


# 3 personal data -----------------------------------------------------------------------------------


def plain_spans(t):
    t, out = t or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"[^0-9]", "", m[0])
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1]))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@given(st.text(alphabet="ab.@-+ ()0159é_\n", max_size=60))
@settings(max_examples=400, deadline=None)
def test_patterns(text):
    assert pii.patterns(text) == plain_spans(text)


def test_personal_data(spark, docs, crowded, empty):
    model = pii.train(docs)
    got = pii.digest(docs, model).collect()
    for r in got:
        text = next(x[1] for x in ROWS if x[0] == r.doc_id)
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in plain_spans(text))
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))
    assert rows(pii.digest(crowded, pii.train(crowded))) == rows(pii.digest(docs, model))
    assert pii.digest(empty, pii.train(empty)).count() == 0
    clean = {r.doc_id: r.text for r in pii.redact(docs, model).collect()}
    assert clean[12] == "mail [EMAIL], [PHONE] or [IP]; card [CARD]." and clean[9] == LONG and clean[5] is None


def test_skip_edges_carry_a_label():
    """A distant repeat of a sure card number is more of a card than the same word alone."""
    counts = np.zeros((pii.SLOTS, pii.LABELS))
    pair = np.diag([50.0, 0, 0, 20.0, 0])
    model = pii.Model(counts + np.array([5.0, 0, 0, 1.0, 0]), counts.copy(), np.zeros((5, 5)), pair)

    def card(text):
        data = np.frombuffer(text.encode(), np.uint8)
        nodes, _ = pii.graph(W.Texts(data, np.array([0, len(data)])))
        return pii.marginals(nodes, model)[-1, 3], len(nodes.skip)

    linked, edges = card("pay 4111111111111111 now, and much later there was 4111x1111x1111x1111")
    single, none = card("pay 4111111111111111 now, and much later there was 4112x1111x1111x1111")
    assert (edges, none) == (1, 0) and linked > 0.7 > 0.4 > single


def test_repeats_of_numbers_written_with_blanks(spark):
    """The second mention has no form that a pattern knows, and is found by the first one's digits."""
    texts = []
    for i in range(300):
        a, b, c = 200 + i, 300 + 7 * i % 600, 1000 + 31 * i % 9000
        again = f"{a}-{b}-{c}" if i % 3 else f"{a}{b}{c}"
        texts.append(f"call +1 ({a}) {b}-{c} today" + (f" and then the same {again} once more" if i % 2 else f" in {1900 + i % 99} with {i % 17} men"))
    texts.append("pay by 4111 1111 1111 1111 now, later 4111111111111112 or 4111/1111/1111/1111 again; ab@x.example.com and ab@y")
    rows_ = [(i, t, "en", None, len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows_, COLUMNS)
    clean = {r.doc_id: r.text for r in pii.redact(df, pii.train(df)).collect()}
    odd = [clean[i] for i in range(1, 300, 2)]
    assert sum(x == "call [PHONE] today and then the same [PHONE] once more" for x in odd) >= 148
    assert clean[0] == "call [PHONE] today in 1900 with 0 men"
    data = np.frombuffer(texts[-1].encode(), np.uint8)
    nodes, _ = pii.graph(W.Texts(data, np.array([0, len(data)])))
    assert set(nodes.skip) >= {(0, 5), (6, 7)} and (0, 4) not in nodes.skip


# 4 sampled pieces ----------------------------------------------------------------------------------


def test_sampling_is_lossless_and_seeded(docs, crowded, empty):
    path = tokens.find("piece_bpe_32k.model")
    encoded = sampling.encode(docs, path, seed=3)
    assert rows(encoded) == rows(sampling.encode(docs.repartition(5), path, seed=3)) == rows(sampling.encode(crowded, path, seed=3))
    assert rows(encoded) != rows(sampling.encode(docs, path, seed=4))
    assert rows(sampling.decode(encoded, path)) == sorted(((r[0], r[1]) for r in ROWS), key=repr)
    assert all(r.lossless for r in sampling.digest(docs, path).collect())
    assert sampling.encode(empty, path).count() == 0


def test_sampling_distribution():
    lattice = sampling.Lattices(tokens.find("piece_bpe_32k.model"))
    n = 40_000
    ids, at = lattice.encode([" hotel"] * n, np.arange(n))
    seen = collections.Counter(tuple(ids[a:b].tolist()) for a, b in zip(at[:-1], at[1:]))
    place = {lattice.bytes_of[i].decode("utf-8", "ignore").replace(" ", "▁"): i for i in range(259, lattice.size)}

    def paths(text):
        if not text:
            yield (), 0.0
        for k in range(1, len(text) + 1):
            if text[:k] in place:
                for rest, w in paths(text[k:]):
                    yield (place[text[:k]], *rest), w + lattice.weight[place[text[:k]]]

    weights = {p: math.exp(w) for p, w in paths("▁hotel")}
    assert set(seen) <= set(weights)
    for p, w in weights.items():
        share = w / sum(weights.values())
        assert abs(seen[p] / n - share) < 5 * math.sqrt(share / n) + 1e-4


# 6 near-duplicates ---------------------------------------------------------------------------------


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < size else [tuple(w[i : i + size]) for i in range(len(w) - size + 1)])


def plain_groups(texts, size, percent):
    """doc_id -> smallest id of its component, by comparing all pairs."""
    sets = {d: [shingles(t, size) for i, t in texts if i == d] for d, _ in texts if d is not None}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, crowded, size, percent):
    got = neardup.groups(docs, size, percent).collect()
    want = plain_groups([(r[0], r[1]) for r in ROWS], size, percent)
    assert len(got) == len(ROWS)
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id is not None and r.doc_id == r.component_id)
    assert rows(neardup.groups(crowded, size, percent)) == sorted(map(tuple, got), key=repr)


@pytest.mark.parametrize("signs, n, walked", [(2, 3000, 500), (4, 6000, 1 << 16), (256, 2000, 300), (1, 1500, 400)])
def test_forest_regions(signs, n, walked):
    """Every run of rows that share DEPTH places is one block, or wholly open; blocks are never too large."""
    import pyarrow as pa

    made = np.random.default_rng(signs)
    keys = made.integers(0, signs, (n, neardup.LONG + 1)).astype(np.uint8)
    keys[:, 0] = made.integers(0, 3, n)
    node = np.arange(n) * 7
    order = np.lexsort((node, *keys.T[::-1]))
    keys, node = keys[order], node[order]
    batches = [
        pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in keys[i : i + 97]], pa.binary()), pa.array(node[i : i + 97])], ["key", "node"])
        for i in range(0, n, 97)
    ]
    most, blocks, open_, runs = 64, {}, {}, {}
    for batch in neardup._walk(iter(batches), most, walked):
        for r in batch.to_pylist():
            blocks.setdefault(r["block"], set()).add(r["node"])
            if r["open"]:
                open_.setdefault(r["region"], set()).add(r["node"])
    for key, one in zip(keys, node.tolist()):
        runs.setdefault(bytes(key[: neardup.DEPTH + 1]), set()).add(one)
    whole = {frozenset(x) for x in [*blocks.values(), *open_.values()]}
    assert all(frozenset(run) in whole for run in runs.values() if len(run) > 1)
    assert max(map(len, blocks.values())) <= 2 * most  # a border's two sides share an address


def test_near_duplicates_without_a_similar_pair(spark):
    texts = [f"word{i} has{i} nothing{i} in{i} common{i} with{i} others{i}" for i in range(50)]
    found = neardup.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [(r.doc_id, r.component_id, r.kept) for r in found.orderBy("doc_id").collect()] == [(i, i, True) for i in range(50)]


def test_near_duplicates_of_none(empty):
    assert neardup.groups(empty).count() == 0


def test_large_groups_are_whole(spark, monkeypatch):
    """Small blocks force depth, cuts and both rounds of crossing cells; the groups stay those of all pairs."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "MEMBERS", 16)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(140):
        words = list(base)
        for k in rng.choice(120, int(rng.integers(0, 9)), replace=False):
            words[k] = f"v{rng.integers(10**6)}"
        texts.append((i, " ".join(words)))
    texts += [(200 + i, " ".join(f"u{i}_{k % 40}" for k in range(60))) for i in range(20)] + [(300, None), (301, "a"), (302, "A")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.groups(df, 3, 85).collect()}
    want = plain_groups(texts, 3, 85)
    assert len(set(want.values())) > 25 and got == want


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=30))
@settings(max_examples=4, deadline=None)
def test_components(spark, edges):
    edges += [(i, i + 1) for i in range(40, 60)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: r for n, r in root.items() if any(n in e and e[0] != e[1] for e in edges)}


# 8 and 10 tokens -----------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@given(st.lists(st.text(alphabet="ab'stTÉéñ½٣ \n\t\r　\x1c\x85 .,!#re 12日ΣςΆ<|endoftext|>ｂ́", max_size=30), min_size=5, max_size=5))
@settings(max_examples=100, deadline=None)
def test_encoder_is_the_library(name, texts):
    encoder = tokens.encoder(tokens.find(name))
    for t in texts:
        assert list(array("I", encoder.encode(t))) == encoder.whole.encode(t, add_special_tokens=False).ids


def library_ids(name, text):
    return tokens.encoder(tokens.find(name)).whole.encode(text or "", add_special_tokens=False).ids + [0]


def test_token_files(spark, docs, crowded, empty):
    path = new_path(spark, "test-files")
    tokenfiles.write(docs, path, tokens.find("byte_bpe_50k.json"), stride=1000)
    want, at = [], 0
    for d, text in sorted(((r[0], r[1]) for r in ROWS), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library_ids("byte_bpe_50k.json", text)
        want.append((d, at, len(ids), zlib.crc32(array("I", ids).tobytes())))
        at += len(ids)
    assert rows(tokenfiles.digest(spark, path)) == sorted(want, key=repr)
    assert tokenfiles.read(spark, path).where("doc_id = 8").first().ids == library_ids("byte_bpe_50k.json", "two words")
    plan = tokenfiles.read(spark, path).where("doc_id = 8")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,8)" in plan
    for name, df, n in (("crowded", crowded, len(ROWS)), ("empty", empty, 0)):
        tokenfiles.write(df, f"{path}-{name}", tokens.find("byte_bpe_50k.json"))
        assert tokenfiles.digest(spark, f"{path}-{name}").count() == n


def test_packing(docs, crowded, empty):
    path = tokens.find("word_bpe_49k.json")
    packed = packing.pack(docs, path).collect()
    want = collections.Counter()
    for d, text, *_ in ROWS:
        ids = library_ids("word_bpe_49k.json", text)
        for k, s in enumerate(range(0, len(ids), 2048)):
            want[d, k, s, len(ids[s : s + 2048]), zlib.crc32(array("I", ids[s : s + 2048]).tobytes())] += 1
    assert collections.Counter(tuple(r[:5]) for r in packed) == want
    check_places([(r.sequence_id, r.offset, r.length) for r in packed], 2048)
    assert len({r.sequence_id for r in packed}) == -(-sum(r.length for r in packed) // 2048)
    assert collections.Counter(tuple(r[:5]) for r in packing.pack(crowded, path).collect()) == want
    assert packing.pack(empty, path).count() == 0
    unique = docs.where("doc_id <> 12")
    made = packing.sequences(unique, packing.pack(unique, path), path)
    assert max(len(r.ids) for r in made.collect()) <= 2048


def check_places(places, capacity):
    by = collections.defaultdict(list)
    for sequence, offset, length in places:
        by[sequence].append((offset, length))
    for items in by.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity


@given(st.lists(st.integers(1, 100), max_size=80))
@settings(max_examples=150, deadline=None)
def test_local_search(sizes):
    sizes = np.array(sizes, np.int64)
    first = packing.best_fit(sizes, 100)
    after = packing.improve([list(b) for b in first], sizes, 100)
    assert sorted(x for b in after for x in b) == list(range(len(sizes)))
    assert all(sizes[b].sum() <= 100 for b in after) and len(after) <= len(first)


def test_swaps_empty_a_bin():
    sizes = np.array([6, 5, 4, 3, 2])  # 6+3, 5+4, 2 fit into two bins of ten only by exchange
    assert len(packing.improve([[0, 3], [1, 2], [4]], sizes, 10)) == 2


def test_single_blanks_are_told_without_cutting():
    """The same answer as to cut a text at single blanks and at all white space."""
    every = [chr(i) for i in range(0x10000) if chr(i).isspace()]
    texts = ["a", " a", "a ", "a b", "a  b", " ", "a b é", *[f"a{c}b é" for c in every], *[f"a{c}b" for c in every], *every]
    for text in texts:
        assert tokens.single_blanks(text) == (text.split(" ") == text.split())


def test_words_met_again_are_not_encoded_again():
    """After six hundred thousand others a word is still known, and its letters don't lie in the memory of pieces too."""
    made = []
    memory = tokens._Memory(lambda word: made.append(word) or word.encode())
    for i in range(600_000):
        memory[str(i)]
    assert memory["0"] == b"0" and made.count("0") == 1
    assert len(memory) + len(memory.old) <= 2 * tokens.WORDS
    encoder = tokens.Encoder(tokens.find("byte_bpe_50k.json"))
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c + d for a in letters for b in letters for c in letters for d in letters[:8]]
    encoder.encode(" ".join(words))
    assert len(encoder.next) == len(words) - 1 > 2 * len(encoder.pieces) > 0


# 9 toxicity ----------------------------------------------------------------------------------------


def all_maximal_segments(x):
    """By the definition: the best segment, then the same on both sides of it."""
    best = None
    for i in range(len(x)):
        for j in range(i + 1, len(x) + 1):
            s = sum(x[i:j])
            if s > 0 and (best is None or (s, i - j) > (best[2], best[0] - best[1])):
                best = (i, j, s)
    if best is None:
        return []
    left = all_maximal_segments(x[: best[0]])
    right = [(a + best[1], b + best[1], s) for a, b, s in all_maximal_segments(x[best[1] :])]
    return [*left, best, *right]


@given(st.lists(st.integers(-7, 5).map(lambda v: v + 0.25 * (v % 3)), max_size=14))
@settings(max_examples=200, deadline=None)
def test_segments(x):
    got = toxicity.segments(np.array(x))
    want = all_maximal_segments(x)
    assert sum(s for *_, s in got) == pytest.approx(sum(s for *_, s in want))
    assert max([s for *_, s in got], default=0) == pytest.approx(max([s for *_, s in want], default=0))
    assert all(s == pytest.approx(sum(x[a:b])) for a, b, s in got)


def test_toxicity_learns(spark, docs, crowded, empty):
    rng = np.random.default_rng(2)
    plain = [f"calm{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(300):
        words = list(rng.choice(plain, 60))
        bad = i % 4 == 0
        if bad:
            for k in rng.choice(60, 4, replace=False):
                words[k] = str(rng.choice(["vilething", "vilest", "rotten", "scoundrel"]))
        texts.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    corpus = spark.createDataFrame(texts, "doc_id long, text string")
    label = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(corpus, label.where("doc_id % 3 <> 0"))
    got = {r.doc_id: r for r in toxicity.score(corpus, model).collect()}
    held = [i for i in range(0, 300, 3)]
    assert np.mean([(got[i].score >= 0.5) == (i % 4 == 0) for i in held]) >= 0.97
    found = next(p for p in got[0].passages)
    assert any(w in texts[0][1][found.start : found.end] for w in ("vile", "rotten", "scoundrel"))
    other = toxicity.score(docs, model)
    assert other.count() == len(ROWS) and other.where("score BETWEEN 0 AND 1").count() == len(ROWS)
    assert rows(toxicity.score(crowded, model)) == rows(other) and toxicity.score(empty, model).count() == 0
    assert "score" in toxicity.annotate(crowded, model).columns and toxicity.annotate(crowded, model).dtypes.count(("score", "double")) == 1


@pytest.mark.parametrize("toxic", [[], [(1, 1)], [(1, 0), (2, 0)]])
def test_toxicity_without_both_classes(spark, docs, toxic):
    labels = spark.createDataFrame(toxic, "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels))
    assert got.select("score").distinct().count() == 1 and got.where(F.col("score").isNull()).count() == 0
