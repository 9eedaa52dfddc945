"""The best words and pairs of neighbouring words of every document, by weights whose frequencies are those of the corpus.

A corpus has nearly as many pairs of words as words, most of them once; as rows with their strings they would be
shuffled three times. Here texts lie in blocks. A block asks the parts of the corpus' vocabulary in how many documents
its terms are, by one sorted array of 64-bit hashes for each part, and gets back as many numbers. Which
part a term belongs to comes from a second hash, so two terms are taken for one only if both agree. Strings stay in the
block: which terms of one document are equal, and in what order they are, is told by the words themselves.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import terms
from docweave.sources.stored import stored

BLOCK = 400_000  # words of a block; a longer text is a block of its own
PART = 1_000_000  # words of the corpus for each part of its vocabulary
NEAR = 1e-6  # scores closer than this are left to the exact ranking
PARTED, ENDED = " ", "\n"  # between words, and between texts of one document; neither is in a word


def blocks(df: DataFrame, key: str) -> DataFrame:
    """``(block, n, words, keys, texts)``: the texts' terms in blocks, and of how many rows; written once."""
    words = F.array_join(terms(F.col("text")), PARTED)
    rows = df.select(key, words.alias("words"), F.lit(1).cast("bigint").alias("n"))
    if not df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        rows = rows.groupBy(key).agg(F.array_join(F.collect_list("words"), ENDED).alias("words"), F.sum("n").alias("n"))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        kept, words, n = [], 0, 0
        for batch in batches:
            text = batch.column("words")
            size = np.array(pc.fill_null(pc.add(pc.count_substring_regex(text, f"[{PARTED}{ENDED}]"), 1), 0))
            size[np.array(pc.fill_null(pc.equal(text, ""), True))] = 0
            n += pc.sum(batch.column("n")).as_py() or 0
            some = np.flatnonzero(size)
            total = np.cumsum(size[some])
            at = 0
            while at < len(some):
                done = total[at - 1] if at else 0
                upto = int(np.searchsorted(total, done + BLOCK - words, "right"))
                if upto == at and not words:
                    upto = at + 1
                if upto > at:
                    kept.append(batch.take(pa.array(some[at:upto])))
                    words += int(total[upto - 1] - done)
                    at = upto
                if at < len(some):
                    yield from row(kept, words, n)
                    kept, words, n = [], 0, 0
        if kept or n:
            yield from row(kept, words, n)

    def row(kept, words, n) -> Iterator[pa.RecordBatch]:
        found = pa.Table.from_batches(kept) if kept else None
        listed = [pa.array([found[c].to_pylist()] if kept else [[]], type_) for c, type_ in ((key, pa.list_(of)), ("words", pa.list_(pa.string())))]
        ids = [pa.array([v], pa.int64()) for v in (uuid.uuid4().int >> 65, n, words)]
        yield pa.RecordBatch.from_arrays(ids + listed, ["block", "n", "words", "keys", "texts"])

    of = _arrow(rows, key)
    laid = rows.mapInArrow(run, f"block long, n long, words long, keys array<{kind}>, texts array<string>")
    return stored(laid, "blocks", tidy=True)


def _arrow(df: DataFrame, key: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[key].dataType)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Terms:
    """What a block holds: each document's terms with their numbers, and the block's terms by part and hash.

    The words are numbered by their order, a term by its words' numbers; so the order of terms is that of their
    strings, since a blank comes before all that a word may hold.
    """

    def __init__(self, texts: list[str], parts: int):
        runs = [r for t in texts for r in t.split(ENDED)]
        of = np.repeat(np.arange(len(texts)), [t.count(ENDED) + 1 for t in texts])
        lists = pc.split_pattern(pa.array(runs, pa.string()), PARTED)
        flat = lists.flatten().dictionary_encode()
        rank = np.array(pc.sort_indices(flat.dictionary))
        code = np.empty(len(rank), np.int64)
        code[rank] = np.arange(len(rank))
        self.vocabulary = flat.dictionary.take(pa.array(rank))
        words = code[np.array(flat.indices)]
        bounds = np.array(lists.offsets, np.int64)
        run = np.repeat(np.arange(len(runs)), np.diff(bounds))
        real = np.array(pc.not_equal(flat.dictionary, ""))[np.array(flat.indices)]  # of a text without words
        self.base = len(rank) + 1
        paired = np.flatnonzero((run[1:] == run[:-1]) & real[1:] & real[:-1])
        doc = of[run]
        at = np.concatenate([doc[real], doc[paired]])
        term = np.concatenate([words[real] * self.base, words[paired] * self.base + words[paired + 1] + 1])
        span = self.base * self.base
        packed, self.tf = np.unique(at * span + term, return_counts=True)
        self.doc, self.term = packed // span, packed % span
        self.distinct, self.which, self.held = np.unique(self.term, return_inverse=True, return_counts=True)
        self.hash, part = self._hashes(parts)
        self.order = np.lexsort((self.hash, part))
        self.bounds = np.searchsorted(part[self.order], np.arange(parts + 1))

    def _hashes(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        digests = b"".join(blake2b(w.encode(), digest_size=16).digest() for w in self.vocabulary.to_pylist())
        both = np.frombuffer(digests, np.uint64).reshape(-1, 2)
        first, second = self.distinct // self.base, self.distinct % self.base
        out = []
        for k in range(2):
            next_ = np.concatenate([np.zeros(1, np.uint64), both[:, k]])[second]
            out.append(_mix(_mix(both[first, k]) + next_ * np.uint64(0x9E3779B97F4A7C15)))
        return out[0], (out[1] % np.uint64(parts)).astype(np.int64)

    def string(self, term: np.ndarray) -> pa.Array:
        first, second = term // self.base, term % self.base
        one = self.vocabulary.take(pa.array(first))
        two = self.vocabulary.take(pa.array(np.maximum(second - 1, 0)))
        return pc.if_else(pa.array(second > 0), pc.binary_join_element_wise(one, two, PARTED), one)


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers of 64 bits, nearly all of them small."""
    return pa.compress(numbers.tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, int(n) * 8, "zstd", asbytes=True), np.int64)


def _ask(parts: int):
    """For each block and part: the hashes of its terms, in order, and in how many of its documents each is."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                texts = batch.column("texts")[i].as_py()
                if not texts:
                    continue
                found = Terms(texts, parts)
                hashes, held = found.hash[found.order], found.held[found.order].astype(np.int64)
                some = np.flatnonzero(np.diff(found.bounds))
                cut = [(found.bounds[p], found.bounds[p + 1]) for p in some]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(batch.column("block")[i].as_py(), len(some))),
                        pa.array(some.astype(np.int32)),
                        pa.array([hashes[a:b].tobytes() for a, b in cut], pa.binary()),
                        pa.array([_pack(held[a:b]) for a, b in cut], pa.binary()),
                    ],
                    ["block", "part", "hashes", "held"],
                )

    return run


def _answer(asked: pa.Table) -> pa.Table:
    """In how many documents of the corpus the terms of a part are, block by block as asked."""
    hashes = [np.frombuffer(b, np.uint64) for b in asked["hashes"].to_pylist()]
    held = np.concatenate([_unpack(b, len(h)) for b, h in zip(asked["held"].to_pylist(), hashes)])
    distinct, which = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(which, held, len(distinct)).astype(np.int64)[which]
    cuts = np.concatenate([[0], np.cumsum([len(h) for h in hashes])])
    answers = [_pack(total[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.table({"block": asked["block"], "part": asked["part"], "held": pa.array(answers, pa.binary())})


def _best(top: int, n: int, parts: int, key: str, of: pa.DataType):
    """Of every document the terms that may be among its ``top``: a few more than these where scores are close."""

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        names = [key, "term", "tf", "df"]
        if not answers.num_rows:  # a block without any term
            return pa.table([pa.array([], t) for t in (of, pa.string(), pa.int64(), pa.int64())], names)
        found = Terms(block["texts"][0].as_py(), parts)
        rows = sorted(zip(answers["part"].to_pylist(), answers["held"].to_pylist()))
        df = np.empty(len(found.order), np.int64)
        df[found.order] = np.concatenate([_unpack(b, found.bounds[p + 1] - found.bounds[p]) for p, b in rows])
        df = df[found.which]
        score = found.tf * (np.log((1.0 + n) / (1.0 + df)) + 1.0)
        order = np.lexsort((-score, found.doc))
        begin = np.searchsorted(found.doc, np.arange(found.doc[-1] + 2))
        last = np.minimum(begin[:-1] + top, begin[1:]) - 1
        limit = score[order[np.maximum(last, 0)]][found.doc]
        near = NEAR * (1.0 + np.abs(limit))
        sure = score > limit + near
        even = np.flatnonzero(np.abs(score - limit) <= near)
        # Terms of one document with equal numbers are equal in score: the first ones stand for them.
        by = even[np.lexsort((found.term[even], df[even], found.tf[even], found.doc[even]))]
        new = np.ones(len(by), bool)
        new[1:] = (np.diff(found.doc[by]) != 0) | (np.diff(found.tf[by]) != 0) | (np.diff(df[by]) != 0)
        place = np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
        keep = np.concatenate([np.flatnonzero(sure), by[place < top]])
        keys = pa.array(block["keys"][0].as_py(), of).take(pa.array(found.doc[keep]))
        return pa.table([keys, found.string(found.term[keep]), pa.array(found.tf[keep]), pa.array(df[keep])], names)

    return run


def candidates(df: DataFrame, key: str, top: int) -> tuple[DataFrame, int]:
    """``(key, term, tf, df)`` of the terms that may be among a document's ``top``, and the number of documents."""
    laid = blocks(df, key)
    n, words = laid.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-words // PART))
    asked = laid.select("block", "texts").mapInArrow(_ask(parts), "block long, part int, hashes binary, held binary")
    answers = asked.groupBy("part").applyInArrow(_answer, "block long, part int, held binary")
    kind = df.schema[key].dataType.simpleString()
    best = _best(top, n, parts, key, _arrow(df, key))
    pairs = laid.select("block", "keys", "texts").groupBy("block").cogroup(answers.groupBy("block"))
    return pairs.applyInArrow(best, f"`{key}` {kind}, term string, tf long, df long"), n
