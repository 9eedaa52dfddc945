"""Structured Streaming: continuous intake, windows, sessions, status (the limiter has its own module).

Every job checkpoints below the shared folder and can be started again after a failure. The batch
functions these jobs call are the ones the rest of the library uses, so batch and stream agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.operators.events import (
    MICROS,
    SESSION_SECONDS,
    WINDOW_SECONDS,
    gap_sessions,
    merge_sessions,
    window_counts,
)
from docweave.operators.relational import latest_by_key
from docweave.session import prepare, scratch
from docweave.sources.stored import folders, remove

COMPACT_EVERY = 16  # batches whose results lie side by side at most


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    """New parquet files below ``path``; zone-less timestamps become TIMESTAMP."""
    prepare(spark)
    df = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )
    casts = {
        f.name: F.col(f.name).cast("timestamp")
        for f in schema.fields
        if isinstance(f.dataType, T.TimestampNTZType)
    }
    return df.withColumns(casts) if casts else df


def accumulate(
    stream: DataFrame,
    partial: Callable[[DataFrame], DataFrame],
    merge: Callable[[DataFrame], DataFrame],
    path: str | None = None,
    compact_every: int = COMPACT_EVERY,
) -> DataFrame:
    """Reduce a stream whose results can be merged; the whole result so far.

    A batch writes the ``partial`` result of its own rows, so only the keys it holds, to a folder of its
    own, and reads nothing else; a batch that is run again overwrites it. Rows may be late by any time.
    Every ``compact_every`` batches the folders are merged to one, which costs as much as one reading.
    The state of the stream is ``path``: the next call on it goes on where the last one ended or was lost.
    """
    spark = stream.sparkSession
    path = path or scratch(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{path}/parts/{number:09d}")
        if (number + 1) % compact_every == 0:
            _compact(spark, path, merge, number)

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    found = _parts(spark, path)
    if not found:
        return merge(partial(spark.createDataFrame([], stream.schema)))
    return merge(spark.read.parquet(*found))


def _parts(spark: SparkSession, path: str, upto: int | None = None) -> list[str]:
    """The newest merged folder and the batches after it; with ``upto`` as they were before that batch's merge."""
    merged = [f for f in folders(spark, f"{path}/merged") if upto is None or int(f) < upto]
    batches = [f for f in folders(spark, f"{path}/parts") if upto is None or int(f) <= upto]
    base = merged[-1:]
    return [f"{path}/merged/{f}" for f in base] + [f"{path}/parts/{f}" for f in batches if not base or f > base[0]]


def _compact(spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], number: int) -> None:
    """Merge all up to a batch. What the merge before it covers goes: that one is whole, and no batch older
    than this one is run again."""
    before = [f for f in folders(spark, f"{path}/merged") if int(f) < number]
    merge(spark.read.parquet(*_parts(spark, path, number))).write.mode("overwrite").parquet(f"{path}/merged/{number:09d}")
    for old in before[:-1]:
        remove(spark, f"{path}/merged/{old}")
    for part in folders(spark, f"{path}/parts"):
        if before and part <= before[-1]:
            remove(spark, f"{path}/parts/{part}")


def ingest(
    stream: DataFrame, transform: Callable[[DataFrame], DataFrame], targets: dict[str, Callable[[DataFrame], DataFrame]], base: str, checkpoint: str
):
    """Documents as they arrive, through the batch transform, to several tables.

    Each micro-batch goes to its own ``batch`` folder of every table, overwritten if the batch is
    run again, so a restart neither loses nor doubles rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        done = transform(batch).persist()
        try:
            for name, project in targets.items():
                project(done).write.mode("overwrite").parquet(f"{base}/{name}/batch={number}")
        finally:
            done.unpersist()

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def rate_windows(stream: DataFrame, path: str | None = None, seconds: int = WINDOW_SECONDS, slide: int = 10) -> DataFrame:
    """Requests per client and sliding window, however late they come."""
    keys = ["client_id", "start", "end"]
    merge = lambda parts: parts.groupBy(*keys).agg(F.sum("requests").alias("requests"))
    return accumulate(stream, lambda batch: window_counts(batch, seconds, slide), merge, path)


def sessions(stream: DataFrame, path: str | None = None, seconds: int = SESSION_SECONDS) -> DataFrame:
    """``(client_id, start, end, events)``: sessions, closed by a pause of ``seconds`` (no fixed life time).

    A late request may join two sessions: those of all batches are merged like single requests.
    """
    merged = accumulate(
        stream,
        lambda batch: gap_sessions(batch, seconds).drop("session"),
        lambda parts: merge_sessions(parts, seconds),
        path,
    )
    end = F.timestamp_micros(F.col("end_us") + seconds * MICROS)
    return merged.select("client_id", F.timestamp_micros("start_us").alias("start"), end.alias("end"), "events")


def latest_status(stream: DataFrame, path: str | None = None) -> DataFrame:
    """Last status of every document, by the changes' own time, not their arrival."""
    newest = lambda rows: latest_by_key(rows, ["document_id"], ["ts", "event_id"])
    out = accumulate(stream.select("document_id", "status", "ts", "event_id"), newest, newest, path)
    return out.select("document_id", "status", F.col("ts").alias("updated_at"))
