"""Token ids in ORC files, in ascending order of document ids.

ORC keeps integers in run-length encoding and gives every stripe row indexes; a Bloom filter on the
document id is written beside them, so a reader of a few documents skips stripes and row groups by
metadata alone, and readers of everything take stripes in parallel. Each row carries the number of its
part and its place in the part, so that the place in the whole corpus needs only the parts' totals.

Null and empty texts have the end id only. Rows with equal ids lie side by side, ordered by text; a null
id comes first. An empty table makes an empty folder of files.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.llm import tokens
from docweave.llm.store import alone

END = 0
SCHEMA = "doc_id long, part int, first long, n_tokens long, ids array<int>"
RUN = 512  # rows turned into a batch at a time


def _encoded(path: str, end: int):
    def run(batches):
        encode, part, first = tokens.encoder(path).encode, TaskContext.get().partitionId(), 0
        tail = np.array([end], np.int32).tobytes()
        for batch in batches:
            for at in range(0, len(batch), RUN):
                some = batch.slice(at, RUN)
                ids = [encode(t) + tail for t in some.column("text").to_pylist()]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                places = np.concatenate([[0], np.cumsum(sizes)])
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("doc_id"),
                        pa.array(np.full(len(some), part, np.int32)),
                        pa.array(first + places[:-1]),
                        pa.array(sizes),
                        pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32))),
                    ],
                    ["doc_id", "part", "first", "n_tokens", "ids"],
                )
                first += int(places[-1])

    return run


def write(documents: DataFrame, path: str, tokenizer: str, end: int = END, stripe_mb: int = 16, stride: int = 1000) -> None:
    """Encode every text and write the files; ``stride``: rows that a row index entry stands for."""
    rows = alone(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    out = rows.mapInArrow(_encoded(tokenizer, end), SCHEMA)
    options = {
        "compression": "zstd",
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": "0.01",
        "orc.create.index": "true",
        "orc.row.index.stride": str(stride),
        "orc.stripe.size": str(stripe_mb << 20),
    }
    out.write.options(**options).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, first, n_tokens, ids; filters on doc_id skip stripes."""
    return spark.read.schema(SCHEMA).orc(path)


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, from the files."""

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            values = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
            at = ids.offsets.to_numpy().astype(np.int64)
            crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), batch.column("first"), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                ["doc_id", "part", "first", "n_tokens", "ids_crc32"],
            )

    rows = read(spark, path).mapInArrow(run, "doc_id long, part int, first long, n_tokens long, ids_crc32 long")
    totals = read(spark, path).groupBy("part").agg(F.max(F.col("first") + F.col("n_tokens")).alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = totals.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    # As many rows as the files have parts: at most the number of shuffle partitions.
    out = rows.join(F.broadcast(parts), "part")
    return out.select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
