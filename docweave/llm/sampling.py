"""Sampled SentencePiece segmentations, and lossless decoding.

A text's piece lattice has an edge for every piece of the vocabulary that fits somewhere. Edges weigh
``1 / (rank + 2.7)``, a piece's rank being its place in the order of merges (Zipf's law), raised to
``alpha``. Forward filtering sums the weights of all paths to each place; backward sampling walks from
the end, taking each edge with its exact share of what reaches the place. The random numbers come from a
hash of the row's key, the word's number in the text and the step, so a row always gets the same
segmentation, in any partition and on any executor.

No piece reaches over the start of a blank run or over a character without a piece, so the lattice falls
into words, and a distinct word is filtered once for each worker. All words of a batch are walked
together. (A vocabulary with pieces that reach over them is refused.) Characters without a piece become
byte pieces, and so does the sign that stands for the blank, so decoding gives back every text.

Null and empty texts have no pieces, and null stays null. A null key counts as a key of its own; equal
keys with equal texts get equal segmentations.
"""

from __future__ import annotations

import re
import zlib
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm import words as W
from docweave.llm.store import alone

MARK = "▁"  # stands for the blank in pieces
HIDDEN = "\ud800"  # stands for that sign itself; no text holds it
BETWEEN = "\ud801"  # nor this one
WORDS = 300_000  # words whose lattices a worker keeps
ALPHA = 1.0


class _Grow:
    """An array that is appended to."""

    def __init__(self, kind):
        self.data, self.n = np.zeros(1 << 16, kind), 0

    def add(self, values: np.ndarray) -> None:
        need = self.n + len(values)
        if need > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(need, len(self.data)), self.data.dtype)])
        self.data[self.n : need] = values
        self.n = need


class Lattices:
    """Vocabulary of a SentencePiece model and the filtered lattices of the words met so far."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.size, self.bytes_of, byte_at = n, [b""] * n, [0] * 256
        self.find = ahocorasick.Automaton()
        single, weight, length = set(), np.zeros(n), np.ones(n, np.int64)
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_at[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                rank = -model.get_score(i) if model.get_score(i) > -n else n
                weight[i] = -alpha * np.log(max(rank, 0) + 2.7)
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
                if not re.fullmatch(f"{MARK}*[^{MARK}]*", piece):
                    raise ValueError(f"piece {i} reaches over the start of a blank run")
                self.find.add_word(piece, i)
                length[i] = len(piece)
                single |= {piece} if len(piece) == 1 else set()
        self.find.make_automaton()
        if not all(byte_at) or any(set(w) - single for w in self.find.keys()):
            raise ValueError("a byte or a character of a piece has no piece of its own")
        self.weight, self.length, self.byte_at = weight, length, byte_at
        known = "".join(map(re.escape, sorted(single - {MARK})))
        self.split = re.compile(f"{MARK}+[{known}]*|[{known}]+|[^{MARK}{known}]" if known else f"{MARK}+|[^{MARK}]").findall
        sizes = np.array([len(b) for b in self.bytes_of])
        self.byte_size, self.byte_start = sizes, np.cumsum(sizes) - sizes
        self.byte_data = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self._empty()

    def _empty(self) -> None:
        self.known: dict[str, int] = {}
        self.last = _Grow(np.int64)  # of each word: its last node
        self.first_edge = _Grow(np.int64)  # of each node: its first incoming edge
        self.piece, self.back, self.upto = _Grow(np.int32), _Grow(np.int32), _Grow(np.float64)  # of each edge

    def _learn(self, new: list[str], odd: list[str]) -> None:
        """Forward filtering of new words: shares of the paths to each node by its incoming edges.

        ``odd``: characters without a piece, which follow the other words. A word has a node before each
        character and one at its end, so places in all words, joined with a sign between, are nodes.
        """
        raw = [(MARK if c == HIDDEN else c).encode("utf-8") for c in odd]
        nodes = np.array([*map(len, new), *map(len, raw)], np.int64) + 1
        start = np.cumsum(nodes) - nodes
        met = np.fromiter(chain.from_iterable(self.find.iter(BETWEEN.join(new))), np.int64).reshape(-1, 2)
        owner = np.repeat(start[len(new) :], nodes[len(new) :] - 1)
        node = np.concatenate([met[:, 0] + 1, owner + 1 + W.ranks(nodes[len(new) :] - 1)])
        piece = np.concatenate([met[:, 1], np.array([self.byte_at[b] for r in raw for b in r], np.int64)])
        key = np.sort(node * self.size + piece)
        node, piece = key // self.size, key % self.size
        end, size = node - np.repeat(start, nodes)[node], self.length[piece]
        counts = np.bincount(node, minlength=int(nodes.sum()))
        first = np.cumsum(counts) - counts
        alpha, share = np.zeros(int(nodes.sum())), np.zeros(len(node))
        by_end = np.argsort(end, kind="stable")
        cuts = np.searchsorted(end[by_end], np.arange(1, int(end.max(initial=0)) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            e = by_end[a:b]  # edges to the k-th node of all words, node after node
            value = alpha[node[e] - size[e]] + self.weight[piece[e]]
            heads = np.flatnonzero(np.diff(node[e], prepend=-1))
            group = np.cumsum(np.diff(node[e], prepend=-1) != 0) - 1
            top = np.maximum.reduceat(value, heads)
            total = top + np.log(np.add.reduceat(np.exp(value - top[group]), heads))
            alpha[node[e[heads]]] = total
            share[e] = np.exp(value - total[group])
        sums = np.cumsum(share)
        before = np.concatenate([[0.0], sums])[first[node]]
        base_node, base_edge = self.first_edge.n, self.piece.n
        self.last.add(base_node + start + nodes - 1)
        self.first_edge.add(base_edge + first)
        self.piece.add(piece)
        self.back.add(size)
        upto = sums - before
        ends_node = np.append(np.flatnonzero(np.diff(node)), len(node) - 1) if len(node) else []
        upto[ends_node] = 2.0  # rounding can't lead past a node's last edge
        self.upto.add(upto)

    def words(self, text: str) -> list[str]:
        return self.split(text.replace(MARK, HIDDEN).replace(" ", MARK))

    def encode(self, texts: list[str | None], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts, and where each one's begin (and the end)."""
        if len(self.known) > WORDS:
            self._empty()
        split = [self.words(t) if t else [] for t in texts]
        known = self.known
        fresh = set().union(*split).difference(known)
        if fresh:
            odd = sorted(w for w in fresh if len(w) == 1 and w not in self.find)
            new = sorted(fresh.difference(odd))
            for w in chain(new, odd):
                known[w] = len(known)
            self._learn(new, odd)
        counts = np.array([len(s) for s in split], np.int64)
        flat = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        seed = np.repeat(W.mix(keys.astype(np.uint64)), counts) + W.ranks(counts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        at = self.last.data[flat]
        active, step = np.arange(len(flat)), 0
        first_edge, piece, back, upto = (g.data for g in (self.first_edge, self.piece, self.back, self.upto))
        who, got = [], []
        while len(active):
            draw = W.mix(seed[active] ^ W.mix(np.array([step + 1], np.uint64)))
            r = (draw >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = first_edge[at[active]]
            open_ = np.flatnonzero(upto[edge] <= r)
            while len(open_):
                edge[open_] += 1
                open_ = open_[upto[edge[open_]] <= r[open_]]
            who.append(active)
            got.append(piece[edge])
            at[active] -= back[edge]
            # A word's first node has no incoming edge: the next node's edges begin where its own would.
            node = at[active]
            active, step = active[first_edge[node] != first_edge[node + 1]], step + 1
        if not got:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        pieces = np.zeros(len(flat), np.int64)
        for w in who:
            pieces[w] += 1
        ends = np.cumsum(pieces)
        out = np.empty(int(ends[-1]), np.int32)
        for k, (w, g) in enumerate(zip(who, got)):
            out[ends[w] - 1 - k] = g
        return out, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts, and where each one's begin (and the end)."""
        size = self.byte_size[ids]
        at = np.repeat(self.byte_start[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return self.byte_data[at], np.concatenate([[0], np.cumsum(size)])[bounds]


@cache
def lattices(path: str, alpha: float) -> Lattices:
    """One for each worker."""
    return Lattices(path, alpha)


def _encoded(batch: pa.RecordBatch, lattice: Lattices):
    for texts in W.slices(batch.column("text"), 1 << 20):
        rows = batch.slice(texts.first, texts.n)
        keys = rows.column("row_key").to_numpy(zero_copy_only=False)
        yield texts, rows, *lattice.encode(rows.column("text").to_pylist(), keys)


def _keyed(documents: DataFrame, seed: int) -> DataFrame:
    return alone(documents, "doc_id", "text").withColumn("row_key", F.xxhash64("doc_id", F.lit(seed)))


def encode(documents: DataFrame, path: str, seed: int = 0, alpha: float = ALPHA) -> DataFrame:
    """doc_id and pieces, a sampled segmentation of each text; null for a null text."""
    keyed = _keyed(documents, seed)

    def run(batches):
        lattice = lattices(path, alpha)
        for batch in batches:
            for _, rows, ids, bounds in _encoded(batch, lattice):
                null = rows.column("text").is_null()
                pieces = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids), mask=null)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pieces], ["doc_id", "pieces"])

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"doc_id {kind}, pieces array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and pieces."""

    def run(batches):
        lattice = lattices(path, ALPHA)
        for batch in batches:
            pieces = batch.column("pieces")
            null = np.asarray(pieces.is_null())
            sizes = np.where(null, 0, np.asarray(pieces.value_lengths().fill_null(0)))
            data, bounds = lattice.decode(pieces.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]))
            raw = data.tobytes()
            text = [None if n else raw[a:b].decode("utf-8") for n, a, b in zip(null, bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    rows = alone(encoded, "doc_id", "pieces")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def digest(documents: DataFrame, path: str, seed: int = 0, alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_pieces, pieces_crc32 (of the ids, little-endian, four bytes each) and lossless: whether they decode to the text."""
    keyed = _keyed(documents, seed)
    names = ["doc_id", "n_pieces", "pieces_crc32", "lossless"]

    def run(batches):
        lattice = lattices(path, alpha)
        for batch in batches:
            for texts, rows, ids, bounds in _encoded(batch, lattice):
                data, at = lattice.decode(ids, bounds)
                view, whole = memoryview(ids.astype("<i4")).cast("B"), np.array_equal(data, texts.data) and np.array_equal(at, texts.offsets)
                same = [whole or bytes(data[a:b]) == bytes(texts.data[c:d]) for a, b, c, d in zip(at[:-1], at[1:], texts.offsets[:-1], texts.offsets[1:])]
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(bounds)), pa.array(crc, pa.int64()), pa.array(same)], names)

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"doc_id {kind}, n_pieces long, pieces_crc32 long, lossless boolean")
