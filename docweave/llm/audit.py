"""How filters interact: what every order of them removes, from wide packed counters.

1. Every document gets the set of filters that it fails (a mask) and its labels.
2. For every mask and label there is one wide integer: a field of ``BITS`` bits for each count of each step
   of each order, holding what one such document adds there. Tasks add up the integers of their documents
   by part, and the sums travel, so that a shuffle carries a few integers a task whatever the corpus holds.
3. The sums of a part meet in two rounds, over ``SPREAD`` tasks and then in one, and are unpacked. A field
   counts to 2^64 - 1 documents, so no carry reaches its neighbour.

The last filter looks at other documents: a text is a repeat if a smaller doc_id has the same one, by its
digest. Documents come to one row per text and id before texts meet, and only texts of several ids meet.

Null texts are empty. A null source and an empty one are the same part. Rows that share an id and a text
repeat nothing, as no smaller id has it; a null id is not smaller than any and repeats nothing. Labels that
contradict each other all hold. An empty table has no parts, so no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.store import alone, keep

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
BITS = 64  # of a field
SPREAD = 32  # tasks in which the sums of a part meet first
PARTS = 512  # parts whose sums a task holds at a time
GOOD, TOXIC = 32, 64  # labels, above the five bits of the mask
_WORD = r"[\x20\x09-\x0D]+"
_SUMS = "part string, salt int, sums binary"


def failures(text: Column, words: Column) -> Column:
    """Bits of the filters A to D, which look at one text alone; ``words``: the text split at blanks."""
    n = F.size(F.array_remove(words, ""))
    distinct = F.size(F.array_remove(F.array_distinct(words), ""))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    bit = lambda fails, value: F.when(fails, value).otherwise(0)
    return (
        bit(n < 50, 1)
        + bit(100 * distinct < 65 * n, 2)
        + bit(100 * capitals > 5 * F.length(text), 4)
        + bit(text.rlike(r"[#$%&*|]"), 8)
    )


@cache
def wide(code: int) -> int:
    """The fields of one document with this mask and these labels: orders, then steps, then counts."""
    fields = np.zeros((len(ORDERS), len(FILTERS), len(COUNTS)), "<u8")
    for o, order in enumerate(ORDERS):
        gone = False
        for s, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            fails = bool(code & bit)
            here = fails and not gone
            redundant = fails and gone
            gone = gone or fails
            alone_fails = code & 31 == bit
            fields[o, s] = [not gone, here, redundant, alone_fails, here and bool(code & GOOD), here and bool(code & TOXIC)]
    return int.from_bytes(fields.tobytes(), "little")


def _packed(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8 or 1, "little")


def unpack(sums: bytes | int) -> np.ndarray:
    """Counts by order, step and count."""
    size = len(ORDERS) * len(FILTERS) * len(COUNTS) * BITS // 8
    data = sums.to_bytes(size, "little") if isinstance(sums, int) else sums.ljust(size, b"\0")
    return np.frombuffer(data, "<u8").astype(np.int64).reshape(len(ORDERS), len(FILTERS), len(COUNTS))


def _rows(parts: dict[str, int], salt: int) -> pa.RecordBatch:
    columns = [pa.array(list(parts), pa.string()), pa.array([salt] * len(parts), pa.int32()), pa.array([_packed(n) for n in parts.values()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["part", "salt", "sums"])


def _first(most: int):
    """Sums of a task's documents (part, code, n); ``most``: parts held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % SPREAD
        held: dict[str, int] = {}
        for batch in batches:
            rows = pa.Table.from_batches([batch]).group_by(["part", "code"]).aggregate([("n", "sum")])
            for part, code, n in zip(rows["part"].to_pylist(), rows["code"].to_pylist(), rows["n_sum"].to_pylist()):
                if part not in held and len(held) >= most:
                    yield _rows(held, salt)
                    held = {}
                held[part] = held.get(part, 0) + n * wide(code)
        if held:
            yield _rows(held, salt)

    return run


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of sums that lie side by side by part."""
    name, total = None, 0
    for batch in batches:
        for part, sums in zip(batch.column("part").to_pylist(), batch.column("sums")):
            if part != name:
                if name is not None:
                    yield _rows({name: total}, 0)
                name, total = part, 0
            total += int.from_bytes(sums.as_buffer(), "little")
    if name is not None:
        yield _rows({name: total}, 0)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of every part: one for each order and step."""
    orders = np.repeat(ORDERS, len(FILTERS))
    steps = np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))
    letter = np.array([FILTERS.index(c) for order in ORDERS for c in order])
    for batch in batches:
        for part, sums in zip(batch.column("part").to_pylist(), batch.column("sums").to_pylist()):
            counts = unpack(sums).reshape(-1, len(COUNTS))
            removed = np.zeros(len(FILTERS), np.int64)
            np.add.at(removed, letter, counts[:, COUNTS.index("removed")])
            columns = [pa.array([part] * len(orders)), pa.array(orders), pa.array(steps), *map(pa.array, counts.T.copy()), pa.array(removed[letter])]
            yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *COUNTS, "shapley"])


def masks(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, code (mask of failed filters, GOOD, TOXIC), n (documents), a few rows a text."""
    text = F.coalesce("text", F.lit(""))
    own = alone(documents, "doc_id", "text", "source").withColumn("words", F.split(text, _WORD)).select(
        F.col("doc_id").cast("long"),
        F.coalesce("source", F.lit("")).alias("part"),
        F.unhex(F.md5(text.cast("binary"))).alias("digest"),
        failures(text, F.col("words")).alias("code"),
    )
    rows = own.groupBy("doc_id", "part", "digest", "code").agg(F.count("*").alias("n"))
    known = alone(labels, "doc_id", "quality", "toxic").where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    flag = lambda c, bit: F.max(F.when(F.col(c) == 1, bit).otherwise(0))
    known = known.agg((flag("quality", GOOD) + flag("toxic", TOXIC)).alias("labels"))
    rows = rows.join(known, "doc_id", "left").withColumn("code", (F.col("code") + F.coalesce("labels", F.lit(0))).cast("int")).drop("labels")
    rows = keep(rows, "masks")
    several = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    several = several.where("first < last").select("digest", "first")
    repeat = F.coalesce((F.col("doc_id") > F.col("first")).cast("int"), F.lit(0)) * 16
    return rows.join(several, "digest", "left").select("part", (F.col("code") + repeat).cast("int").alias("code"), "n")


def audit(documents: DataFrame, labels: DataFrame, parts: int = PARTS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    sums = masks(documents, labels).mapInArrow(_first(parts), _SUMS)
    sums = sums.repartition("part", "salt").sortWithinPartitions("part").mapInArrow(_again, _SUMS)
    sums = sums.repartition("part").sortWithinPartitions("part").mapInArrow(_again, _SUMS)
    counts = ", ".join(f"{c} long" for c in (*COUNTS, "shapley"))
    return sums.mapInArrow(_tables, f"part string, filter_order string, step int, {counts}")
