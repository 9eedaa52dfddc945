"""Cross-tokeniser alignment against whole texts encoded at once, and the matrix products against dense ones."""

import hashlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
from hypothesis import example, given, settings
from hypothesis import strategies as st

from docweave.llm import alignment, queries, tokens
from tests.llm.conftest import rows

PATHS = tokens.find("byte_bpe_50k.json"), tokens.find("piece_bpe_32k.model")


@cache
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


@cache
def byte_of_sign():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    for b in range(256):
        if b not in shown:
            out[chr(256 + len(out) - len(shown))] = b
    return out


def plain_groups(text):
    """Groups of (a ids, b ids), from whole texts."""
    if not text:
        return []
    a, b = libraries()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    of_a = [bytes(byte_of_sign()[c] for c in a.id_to_token(i)) for i in ids_a]
    of_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    want = (" " + text).encode()
    if b"".join(of_a) != want or b"".join(of_b) != want:
        return []
    ends_a, ends_b = np.cumsum([len(x) for x in of_a]).tolist(), np.cumsum([len(x) for x in of_b]).tolist()
    out, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(end) + 1, ends_b.index(end) + 1
        out.append((ids_a[i:k], ids_b[j:m]))
        i, j = k, m
    return out


def plain(table):
    """The contract's rows."""
    groups = [plain_groups(text) for _, text in table]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    count = Counter(p for c in links for p in c)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (i, _), g, c in zip(table, groups, links):
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        n_best = sum(n for p, n in c.items() if count[p] == best[p[0]])
        sums = sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()), n_best, sum(n * count[p] for p, n in c.items())
        out.append((i, *sums, hashlib.sha256(shown.encode()).hexdigest() if g else ""))
    return sorted(out, key=repr)


def matrices(draw, n, m):
    return np.array(draw(st.lists(st.lists(st.sampled_from([0, 0, 1, 2]), min_size=m, max_size=m), min_size=n, max_size=n)), np.int64).reshape(n, m)


@given(st.data(), st.integers(0, 6), st.integers(1, 6), st.integers(1, 6), st.sampled_from([1, 3, 1 << 22]))
@settings(max_examples=200, deadline=None)
def test_products(data, n, m, k, work):
    x, y = matrices(data.draw, n, m), matrices(data.draw, m, k)
    sparse = lambda d: alignment.summed(*np.nonzero(d), d[np.nonzero(d)], d.shape)
    before, alignment.WORK = alignment.WORK, work
    try:
        got = alignment.product(sparse(x), sparse(y))
    finally:
        alignment.WORK = before
    dense = np.zeros((n, k), np.int64)
    dense[got.rows(), got.columns] = got.values
    assert len(got) == n and (dense == x @ y).all()
    turned = sparse(x).turned()
    back = np.zeros((m, n), np.int64)
    back[turned.rows(), turned.columns] = turned.values
    assert (back == x.T).all()


@given(st.lists(st.integers(1, 5), min_size=1, max_size=12), st.randoms())
def test_groups_lie_between_common_ends(lengths, rng):
    total = sum(lengths)
    cuts = sorted({total, *(rng.randint(1, total) for _ in range(rng.randint(0, 8)))})
    other = np.diff([0, *cuts])
    of_a, of_b = alignment.byte_groups(np.array(lengths), other)
    common = sorted(set(np.cumsum(lengths).tolist()) & set(cuts))
    place = lambda ends: [sum(c < e for c in common) for e in ends]
    assert of_a.tolist() == place(np.cumsum(lengths)) and of_b.tolist() == place(cuts)


SIGNS = st.lists(st.sampled_from(list("ab'sT1.,\"é日🙂Ⅷ \n\t\r  \x00\x1ć") + ["▁", "<0x0A>", "<|endoftext|>", "</s>", "the ", "  ", "\n\n"]), max_size=30).map("".join)


@given(st.lists(SIGNS, min_size=1, max_size=4))
@example(["a\n b", " a", "a ", "\n", " ", "a\nb c", "▁", "it's 'so' \"x\".\n(y)", "x" * 300, "a\n\n b", "é" * 300 + " a"])
@settings(max_examples=400, deadline=None)
def test_units_are_whole_texts(texts):
    both = alignment.pair(*PATHS)
    for text, (counts, shown, keys, times) in zip(texts, both.documents(texts)):
        groups = plain_groups(text)
        want = Counter((x, y) for a, b in groups for x in a for y in b)
        assert counts.tolist() == [sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(want.values())]
        assert {divmod(k, both.size_b): n for k, n in zip(keys.tolist(), times.tolist())} == want
        assert shown == (hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups).encode()).hexdigest() if groups else "")


def test_memory_is_let_go(monkeypatch):
    monkeypatch.setattr(alignment, "UNITS", 50)
    both = alignment.Pair(*PATHS)
    for k in range(30):
        texts = [f"word{k} and{i} more{k * i} " + "y" * (250 if i % 3 else 5) for i in range(10)]
        for text, got in zip(texts, both.documents(texts)):
            assert got[0][2] == len(plain_groups(text))
        assert len(both.known) == len(both.groups) == both.fine.n <= 50


def test_alignment(spark, docs, crowded, empty):
    def run(df, size):
        aligned = alignment.align(df, *PATHS, chunk_bytes=size)
        out = alignment.digest(aligned, alignment.pair_counts(aligned, alignment.pair(*PATHS).size_b))
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        return rows(out.select(names))

    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    assert run(docs, 100) == want == run(docs.repartition(3), 1 << 20) == run(crowded, 5000)
    assert run(empty, 100) == []
    assert run(docs.where("text IS NULL OR text = ''"), 100) == [(4, 0, 0, 0, 0, 0, 0, ""), (5, 0, 0, 0, 0, 0, 0, "")]


def test_query(spark):
    base = "/root/testdata/sf0.001"
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{base}/documents.parquet").collect()]
    got = queries.QUERIES["op13_token_alignment"](spark, base)
    assert rows(got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) == plain(table)
