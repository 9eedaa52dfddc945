"""Sequences of a fixed capacity, filled by best fit and then by swaps.

Documents are encoded and cut into pieces only where they are longer than a sequence. Pieces are dealt
into groups of bounded size; a task packs a group: best fit in descending order, then a local search
that takes the emptiest sequences and moves pieces out of them, or exchanges one for one, two for one or
one for two, whenever the sum of squared fills grows. Sequences that stay underfull go on to a next
round with those of other groups, until they all fit into one group.

Null and empty texts are the end id alone. Repeated rows are packed as often as they occur. An empty
table has no sequences.
"""

from __future__ import annotations

import zlib
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm import tokens
from docweave.llm.store import alone, keep

CAPACITY = 2048
END = 0
GROUP = 4096  # pieces that a task packs at a time
UNDERFULL = 0.99  # sequences below go on to the next round
VICTIMS = 16  # sequences without an improving step, emptiest first, after which the search ends


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Items in descending order, each into the fullest bin that it fits; equal sizes in order."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what is free in them
    open_ = 0  # bit f is set: a bin has f free
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fits = open_ >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                open_ &= ~(1 << free)
            bins[b].append(item)
        else:
            free, b = capacity, len(bins)
            bins.append([item])
        room[free - size].append(b)
        open_ |= 1 << (free - size)
    return bins


def improve(bins: list[list[int]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Moves and swaps between underfull bins while the sum of squared fills grows; empty bins go."""
    fill = [int(sizes[b].sum()) for b in bins]
    full = [b for b, f in zip(bins, fill) if f >= capacity]
    bins = [b for b, f in zip(bins, fill) if f < capacity]
    fill = [f for f in fill if f < capacity]
    order: list[tuple[int, int]] = []
    for i, f in enumerate(fill):
        insort(order, (f, i))
    tried = 0
    while tried < min(VICTIMS, len(order)):
        f, v = order[tried]
        step = _step(v, bins, fill, sizes, capacity)
        if step is None:
            tried += 1
            continue
        give, other, take = step
        order.remove((f, v))
        order.remove((fill[other], other))
        bins[v] = [x for x in bins[v] if x not in give] + take
        bins[other] = [x for x in bins[other] if x not in take] + give
        for b in (v, other):
            fill[b] = int(sizes[bins[b]].sum()) if bins[b] else 0
            if 0 < fill[b] < capacity:
                insort(order, (fill[b], b))
        tried = 0
    return full + [b for b in bins if b]


def _step(v: int, bins, fill, sizes, capacity) -> tuple[list[int], int, list[int]] | None:
    """The step that fills another bin, at least as full as ``v``, the most: what v gives, to whom, for what."""
    others = [b for b in range(len(bins)) if b != v and fill[v] <= fill[b] < capacity]
    if not others:
        return None
    free = capacity - np.array([fill[b] for b in others])
    mine = bins[v]
    gifts = [[x] for x in mine] + [[a, b] for i, a in enumerate(mine[:12]) for b in mine[i + 1 : 12]]
    single = [(x, k) for k, b in enumerate(others) for x in bins[b]]
    what = np.array([sizes[x] for x, _ in single])
    room = free[[k for _, k in single]]
    pairs = None
    best: tuple[int, tuple] | None = None
    for give in gifts:
        size = int(sizes[give].sum())
        if len(give) == 1:
            left = np.where(free >= size, size, 0)
            k = int(left.argmax())
            if left[k]:
                fits = np.where(free >= size, free, capacity + 1)
                k = int(fits.argmin())  # the fullest bin that takes it
                if best is None or size > best[0]:
                    best = (size, (give, others[k], []))
        gain = size - what
        gain = np.where((gain > 0) & (gain <= room), gain, 0)
        j = int(gain.argmax())
        if gain[j] and (best is None or gain[j] > best[0]):
            best = (int(gain[j]), (give, others[single[j][1]], [single[j][0]]))
        if len(give) == 1 and best is None:
            if pairs is None:
                two = [(x, y, k) for k, b in enumerate(others) for i, x in enumerate(bins[b][:12]) for y in bins[b][i + 1 : 12]]
                pairs = (two, np.array([sizes[x] + sizes[y] for x, y, _ in two]), free[[k for *_, k in two]])
            two, both, room2 = pairs
            if two:
                gain = np.where((size - both > 0) & (size - both <= room2), size - both, 0)
                j = int(gain.argmax())
                if gain[j]:
                    best = (int(gain[j]), (give, others[two[j][2]], list(two[j][:2])))
    return best[1] if best else None


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and a number of the row."""

    def run(batches):
        encode = tokens.encoder(tokenizer).encode
        tail = np.array([end], np.int32).tobytes()
        names = ["at", "piece", "start", "length", "ids_crc32"]
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for at, text in enumerate(batch.column("text").to_pylist()):
                ids = memoryview(encode(text) + tail)
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    for column, value in zip(rows, (at, piece, start // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            at, *rest = rows
            columns = [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(rest[0], pa.int32())]
            columns += [pa.array(c, pa.int64()) for c in rest[1:]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names[1:]])

    documents = alone(documents, "doc_id", "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    out = documents.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")
    return out.withColumn("row", F.monotonically_increasing_id())


def _round(rows: DataFrame, number: int, groups: int, capacity: int) -> DataFrame:
    """row, length, sequence_id, offset, fill after packing each of ``groups`` groups of rows."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        sizes = table["length"].to_numpy()
        bins = improve(best_fit(sizes, capacity), sizes, capacity)
        sequence, offset, fill = (np.zeros(len(sizes), np.int64) for _ in range(3))
        base = (number << 56) | (table["part"][0].as_py() << 16)
        for i, b in enumerate(bins):
            b = sorted(b)
            sequence[b] = base + i
            offset[b] = np.cumsum(sizes[b]) - sizes[b]
            fill[b] = sizes[b].sum()
        return pa.table([table["row"], table["length"], pa.array(sequence), pa.array(offset), pa.array(fill)], names)

    names = ["row", "length", "sequence_id", "offset", "fill"]
    part = F.pmod(F.xxhash64("row", F.lit(number)), F.lit(groups)).alias("part")
    return rows.select("row", "length", part).groupBy("part").applyInArrow(pack, ", ".join(f"{c} long" for c in names))


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    cut = keep(pieces(documents, tokenizer, capacity, end), "pieces")
    whole = cut.where(F.col("length") >= capacity)
    rest, number, done = cut.where(F.col("length") < capacity).select("row", "length"), 1, []
    n = rest.count()
    while n:
        groups = -(-n // GROUP)
        packed = keep(_round(rest, number, groups, capacity), "packed")
        if groups == 1:
            done.append(packed)
            break
        below = F.col("fill") < UNDERFULL * capacity
        done.append(packed.where(~below))
        rest = packed.where(below).select("row", "length")
        before, n = n, rest.count()
        number += 1
        if n > 0.9 * before:  # no more to be won from other groups
            done[-1] = packed
            break
    alone_ = whole.select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for packed in done:
        place = packed.select("row", "sequence_id", "offset")
        alone_ = alone_.union(cut.join(place, "row").select(*alone_.columns))
    return alone_


def sequences(documents: DataFrame, packed: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The packed sequences themselves: sequence_id and ids, for documents with unique ids."""

    def run(batches):
        encode = tokens.encoder(tokenizer).encode
        tail = np.array([end], np.int32).tobytes()
        for batch in batches:
            doc, start, ids = [], [], []
            for at, text in enumerate(batch.column("text").to_pylist()):
                all_of = np.frombuffer(encode(text) + tail, np.int32)
                for s in range(0, len(all_of), capacity):
                    doc.append(at)
                    start.append(s)
                    ids.append(all_of[s : s + capacity])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(start, pa.int64()), pa.array(ids, pa.list_(pa.int32()))],
                ["doc_id", "start", "ids"],
            )

    documents = alone(documents, "doc_id", "text")
    kind = documents.schema["doc_id"].dataType.simpleString()
    parts = documents.mapInArrow(run, f"doc_id {kind}, start long, ids array<int>")
    joined = parts.join(packed.select("doc_id", "start", "sequence_id", "offset"), ["doc_id", "start"])
    listed = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # a sequence's pieces: capacity ids at most
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(listed, lambda x: x["ids"])).alias("ids"))
