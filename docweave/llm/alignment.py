"""Which tokens of two tokenisers say the same bytes, and how often ids meet in a corpus.

1. Tokens and bytes make two 0/1 matrices A and B (a row a token, a column a byte) in compressed rows. The row
   products A·Bᵀ (Gustavson: a row of the product is the sum of the rows that its entries name) give the
   overlap links: the tokens that share bytes, and how many. A token that shares no byte group with the one
   before it begins a group, which is what lies between two places at which tokens of both sides end.
2. The incidence of ids and groups makes two more matrices; their row products give, for every pair of ids,
   how many pairs of tokens share a group.
3. No token of either side reaches over a blank or line end that stands alone between other signs, as no
   piece holds one inside or at its end. Texts fall into units there, and a distinct unit is worked out once
   a worker; all units of a batch are worked out together. (A vocabulary with such pieces is refused.)
4. Documents are gathered to chunks of ``CHUNK`` bytes. A chunk's distinct pairs, not those of its documents,
   are counted over the corpus by a shuffle and come back to it, one number a pair.

Null and empty texts, and those whose tokens don't join to their bytes (with the blank before them), have no
tokens: zeros and an empty digest. Rows that share an id are documents of their own; ids may be null. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.sampling import _Grow
from docweave.llm.store import alone, keep
from docweave.llm.tokens import _BYTES
from docweave.llm.words import ranks

MARK = "▁"  # stands for the blank in pieces
CHUNK = 8 << 20  # bytes of text of a chunk
PIECE = 1 << 20  # bytes of text, or of units, worked on at a time
WORK = 1 << 22  # entries of a product summed up at a time
UNITS = 300_000  # units that a worker keeps
LONG = 200  # units of more signs are not kept
_ALIGNED = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, at binary, times binary, pairs array<long>, docs array<long>"
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_REGULAR = re.compile(r"[ \n][^ \n]*")


class Rows:
    """A sparse matrix in compressed rows: row i has the entries ``starts[i]`` to ``starts[i + 1]``."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int):
        self.starts, self.columns, self.values, self.width = starts, columns, values, width

    def __len__(self) -> int:
        return len(self.starts) - 1

    def rows(self) -> np.ndarray:
        """The row of every entry."""
        return np.repeat(np.arange(len(self)), np.diff(self.starts))

    def turned(self) -> Rows:
        order = np.argsort(self.columns, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(self.columns, minlength=self.width))])
        return Rows(starts, self.rows()[order], self.values[order], len(self))


def summed(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, shape: tuple[int, int]) -> Rows:
    """The matrix of these entries; entries of the same place are summed up."""
    key = rows * np.int64(shape[1]) + columns
    if len(key) > 1 and not (key[1:] >= key[:-1]).all():
        order = np.argsort(key, kind="stable")
        key, rows, columns, values = key[order], rows[order], columns[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(values, first) if len(first) else values[:0]
    starts = np.concatenate([[0], np.cumsum(np.bincount(rows[first], minlength=shape[0]))])
    return Rows(starts, columns[first], total, shape[1])


def product(x: Rows, y: Rows) -> Rows:
    """x·y by rows: each entry of a row of x adds that row of y. ``WORK`` entries are summed up at a time."""
    size = np.diff(y.starts)
    work = np.concatenate([[0], np.cumsum(size[x.columns])])[x.starts]
    parts, low = [], 0
    while low < len(x):
        high = max(low + 1, int(np.searchsorted(work, work[low] + WORK, "right")) - 1)
        part = slice(x.starts[low], x.starts[high])
        use = x.columns[part]
        n = size[use]
        row = np.repeat(np.repeat(np.arange(high - low), np.diff(x.starts[low : high + 1])), n)
        at = np.repeat(y.starts[use], n) + ranks(n)
        parts.append(summed(row, y.columns[at], np.repeat(x.values[part], n) * y.values[at], (high - low, y.width)))
        low = high
    if not parts:
        return Rows(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), y.width)
    ends = np.cumsum([0] + [len(p.columns) for p in parts])
    starts = np.concatenate([[0], *[p.starts[1:] + e for p, e in zip(parts, ends[:-1])]])
    return Rows(starts, np.concatenate([p.columns for p in parts]), np.concatenate([p.values for p in parts]), y.width)


def incidence(lengths: np.ndarray) -> Rows:
    """Tokens by bytes: tokens lie one after the other."""
    starts = np.concatenate([[0], np.cumsum(lengths)])
    return Rows(starts, np.arange(starts[-1]), np.ones(starts[-1], np.int64), int(starts[-1]))


def byte_groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of every token on both sides, from the tokens' lengths in bytes (equal sums, none 0)."""
    overlap = product(incidence(a), incidence(b).turned())
    first, last = overlap.columns[overlap.starts[:-1]], overlap.columns[overlap.starts[1:] - 1]
    of_a = np.cumsum(np.concatenate([[0], first[1:] > last[:-1]])) if len(a) else np.zeros(0, np.int64)
    of_b = np.zeros(len(b), np.int64)
    of_b[overlap.columns] = of_a[overlap.rows()]
    return of_a, of_b


class Pair:
    """Two tokenisers: a byte-level one (A) and a piece model that puts a blank before each text (B)."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        sign_of = {ord(s) if isinstance(s, str) else s: byte for byte, s in _BYTES.items()}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            signs = [sign_of.get(ord(c)) for c in token]
            self.bytes_a[i] = bytes(signs) if None not in signs else token.encode()
        n = self.b.get_piece_size()
        self.bytes_b = [b""] * n
        for i in range(n):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.bytes_b[i] = bytes([int(piece[3:5], 16)])
            elif not (self.b.is_control(i) or self.b.is_unknown(i)):
                self.bytes_b[i] = piece.replace(MARK, " ").encode()
                if not re.fullmatch(f"{MARK}*[^{MARK}\n]*", piece):
                    raise ValueError(f"piece {i} reaches over a blank or a line end")
        self.blank = self.b.piece_to_id(MARK)
        self.size_a, self.size_b = len(self.bytes_a), n
        self.length_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.most = max(self.size_a, self.size_b)
        self.text = [f"{i}{sign}" for sign in ",|;" for i in range(self.most)]
        self._begin()

    def _begin(self) -> None:
        """Forget all units. Of the unit i: counts, whether it can be aligned, its groups and its pairs."""
        self.known: dict[str, int] = {}
        self.counts, self.fine = _Grow(np.int64), _Grow(np.bool_)
        self.groups: list[str] = []
        self.ends, self.keys, self.times = _Grow(np.int64), _Grow(np.int64), _Grow(np.int64)
        self.ends.add(np.zeros(1, np.int64))

    def _ids_b(self, units: list[str]) -> list[list[int]]:
        """A unit's first blank is the one that the model adds; one with a line end loses it again."""
        ids = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        for i, u in enumerate(units):
            if u[0] != " ":
                if ids[i][:1] != [self.blank]:
                    raise ValueError("the added blank is no piece of its own before a line end")
                del ids[i][0]
        return ids

    def _ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bool]]:
        """Ids of both sides, their number by unit, and which units come back whole (others have none)."""
        some_a, some_b = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)], self._ids_b(units)
        joined = "".join(units).encode()
        fine = [True] * len(units)
        if any(b"".join(map(table.__getitem__, chain.from_iterable(ids))) != joined for table, ids in ((self.bytes_a, some_a), (self.bytes_b, some_b))):
            for i, unit in enumerate(units):
                want = unit.encode()
                if b"".join(map(self.bytes_a.__getitem__, some_a[i])) != want or b"".join(map(self.bytes_b.__getitem__, some_b[i])) != want:
                    fine[i], some_a[i], some_b[i] = False, [], []
        out = []
        for ids in (some_a, some_b):
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            out += [np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum())), sizes]
        return *out, fine

    def add(self, units: list[str]) -> None:
        """Align units, all in one go."""
        n = len(units)
        a, size_a, b, size_b, fine = self._ids(units)
        group_a, group_b = byte_groups(self.length_a[a], self.length_b[b])
        n_groups = int(group_a[-1]) + 1 if len(group_a) else 0
        of_a = np.repeat(np.arange(n), size_a)
        # A group lies in one unit: rows are a unit's ids, columns groups, then groups and ids.
        named, row = np.unique(of_a * self.size_a + a, return_inverse=True)
        ids_by_group = summed(row, group_a, np.ones(len(a), np.int64), (len(named), n_groups))
        group_by_ids = summed(group_b, b, np.ones(len(b), np.int64), (n_groups, self.size_b))
        links = product(ids_by_group, group_by_ids)
        rows = links.rows()
        unit_of, id_a = named[rows] // self.size_a, named[rows] % self.size_a
        n_links = np.bincount(unit_of, links.values, minlength=n).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], group_a[1:] != group_a[:-1]])) if n_groups else np.zeros(0, np.int64)
        groups_of = np.bincount(of_a[starts], minlength=n)
        self.groups += self._shown(a, group_a, b, group_b, size_a + size_b)
        self.counts.add(np.stack([size_a, size_b, groups_of, n_links], 1).astype(np.int64).ravel())
        self.fine.add(np.array(fine))
        self.ends.add(self.ends.data[self.ends.n - 1] + np.cumsum(np.bincount(unit_of, minlength=n)))
        self.keys.add(id_a * self.size_b + links.columns)
        self.times.add(links.values)

    def _shown(self, a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, sizes: np.ndarray) -> list[str]:
        """Each unit's groups as text, a semicolon after each."""
        side = np.concatenate([2 * group_a, 2 * group_b + 1])
        order = np.argsort(side, kind="stable")
        side, ids = side[order], np.concatenate([a, b])[order]
        sign = np.zeros(len(ids), np.int64)  # a comma
        if len(ids):
            sign[:-1][side[1:] != side[:-1]] = 1  # what ends a side
            sign[-1] = 1
            sign[(sign == 1) & (side % 2 == 1)] = 2
        parts = list(map(self.text.__getitem__, (sign * self.most + ids).tolist()))
        at = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        return ["".join(parts[x:y]) for x, y in zip(at[:-1], at[1:])]

    def learn(self, units: list[str]) -> None:
        """Align new units, about ``PIECE`` bytes at a time."""
        low, size = 0, 0
        for i, u in enumerate(units):
            self.known[u] = len(self.groups) + i - low
            size += len(u)
            if size >= PIECE or i + 1 == len(units):
                self.add(units[low : i + 1])
                low, size = i + 1, 0

    def forget(self, units: list[str], kept: int) -> None:
        """Let the latest units go, down to ``kept``; all of them when too many are held."""
        if len(self.known) > UNITS:
            self._begin()
        elif units:
            for u in units:
                del self.known[u]
            del self.groups[kept:]
            self.counts.n, self.fine.n, self.ends.n = 4 * kept, kept, kept + 1
            self.keys.n = self.times.n = int(self.ends.data[kept])

    def documents(self, texts: list[str | None]) -> list[tuple[np.ndarray, str, np.ndarray, np.ndarray]]:
        """Counts, digest of the groups, and sorted pairs with their links, of each text."""
        units = [units_of(t) for t in texts]
        new = set().union(*units).difference(self.known)
        self.learn([u for u in new if len(u) <= LONG])
        kept, long = len(self.groups), [u for u in new if len(u) > LONG]
        self.learn(long)
        ends, counts, fine = self.ends.data, self.counts.data[: self.counts.n].reshape(-1, 4), self.fine.data
        nothing, out = np.zeros(0, np.int64), []
        for own in units:
            at = np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))
            if not len(at) or not fine[at].all():
                out.append((np.zeros(4, np.int64), "", nothing, nothing))
                continue
            n = ends[at + 1] - ends[at]
            where = np.repeat(ends[at], n) + ranks(n)
            key, times = self.keys.data[where], self.times.data[where]
            order = np.argsort(key)
            key, times = key[order], times[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            shown = "".join(map(self.groups.__getitem__, at.tolist()))
            out.append((counts[at].sum(0), hashlib.sha256(shown[:-1].encode()).hexdigest(), key[first], np.add.reduceat(times, first)))
        self.forget(long, kept)
        return out


def units_of(text: str | None) -> list[str]:
    """A text, with a blank before it, in pieces that no token reaches over."""
    if not text:
        return []
    if " ".join(text.split()) == text.replace("\n", " "):
        return _REGULAR.findall(" " + text)
    return _CUT.split(" " + text)


@cache
def pair(path_a: str, path_b: str) -> Pair:
    """One for each worker."""
    return Pair(path_a, path_b)


def _align(path_a: str, path_b: str, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(path_a, path_b)
        chunk, size, held = TaskContext.get().partitionId() << 32, 0, []
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            low, some = 0, 0
            for i, text in enumerate(texts):
                some += len(text or "")
                if some >= PIECE or i + 1 == len(texts):
                    held += zip(ids[low : i + 1], both.documents(texts[low : i + 1]))
                    size, low, some = size + some, i + 1, 0
                    if size >= chunk_bytes:
                        yield from _chunk(chunk, held)
                        chunk, size, held = chunk + 1, 0, []
        if held:
            yield from _chunk(chunk, held)

    return run


_SCHEMA = pa.schema(
    [("chunk", pa.int64()), ("doc_id", pa.int64())]
    + [(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")]
    + [("groups_sha256", pa.string()), ("at", pa.binary()), ("times", pa.binary())]
    + [("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))]
)


def _chunk(chunk: int, held: list) -> Iterator[pa.RecordBatch]:
    """The documents of a chunk, their pairs as places in its list of distinct pairs, and then that list."""
    pairs, docs = np.unique(np.concatenate([h[1][2] for h in held]), return_counts=True)
    for low in range(0, len(held), 512):
        part = held[low : low + 512]
        counts = np.array([h[1][0] for h in part])
        columns = [
            [chunk] * len(part),
            [h[0] for h in part],
            *counts.T.copy(),
            [h[1][1] for h in part],
            [np.searchsorted(pairs, h[1][2]).astype("<i4").tobytes() for h in part],
            [h[1][3].astype("<i8" if h[1][3].max(initial=0) > 2**31 - 1 else "<i4").tobytes() for h in part],
            [None] * len(part),
            [None] * len(part),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)
    last = [[chunk], *[[None]] * 8, [pairs], [docs]]
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(last, _SCHEMA)], schema=_SCHEMA)


def align(documents: DataFrame, path_a: str, path_b: str, chunk_bytes: int = CHUNK) -> DataFrame:
    """Written rows of all documents, and one of each chunk with its distinct pairs and their documents.

    A pair is ``id of A * vocabulary of B + id of B``.
    """
    rows = alone(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return keep(rows.mapInArrow(_align(path_a, path_b, chunk_bytes), _ALIGNED), "aligned")


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """pair, n (documents that hold it linked), best (no pair with its id of A is in more).

    An id of A meets at most ``size_b`` ids of B, which bounds the groups of the window.
    """
    rows = aligned.where("pairs IS NOT NULL").select(F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("docs").alias("docs"))))
    counts = rows.groupBy("pair").agg(F.sum("docs").alias("n"))
    most = F.max("n").over(Window.partitionBy((F.col("pair") - F.col("pair") % size_b)))
    return counts.withColumn("best", F.col("n") == most)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's counts lie before its documents."""
    n, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        counts, at, times = batch.column("counts"), batch.column("at").to_pylist(), batch.column("times").to_pylist()
        rows, sums = [], []
        for i, place in enumerate(at):
            if place is None:
                found = counts[i].values
                n, best = found.field("n").to_numpy(), found.field("best").to_numpy(zero_copy_only=False).astype(np.int64)
                continue
            place = np.frombuffer(place, "<i4")
            wide = len(place) and len(times[i]) == 8 * len(place)
            links = np.frombuffer(times[i], "<i8" if wide else "<i4").astype(np.int64)
            rows.append(i)
            sums.append((int(links @ best[place]), int(links @ n[place])))
        if rows:
            own = batch.take(pa.array(rows))
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
            columns = [own.column(c) for c in names] + [pa.array([s[k] for s in sums], pa.int64()) for k in (0, 1)] + [own.column("groups_sha256")]
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_best", "count_sum", "groups_sha256"])


def digest(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    pairs = aligned.where("pairs IS NOT NULL").select("chunk", F.posexplode("pairs").alias("place", "pair"))
    told = pairs.join(counts, "pair").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("place", "n", "best"))).alias("counts"))
    own = aligned.where("pairs IS NULL").drop("pairs", "docs")
    both = told.select("chunk", F.lit(0).alias("kind"), "counts").unionByName(own.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    rows = both.repartition("chunk").sortWithinPartitions("chunk", "kind")
    return rows.mapInArrow(
        _told, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )
