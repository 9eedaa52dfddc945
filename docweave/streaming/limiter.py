"""The exact limiter as a stream: requests in any order, verdicts corrected where a late one changes them.

A client's requests are kept in slots as long as the window. Whether a request passes depends on the
admitted ones of its own slot and of the slot before, on nothing else. So a batch judges the slots that it
touches, each with the one before, and goes on to the next slot only while the admitted ones of a slot have
changed. What a batch costs grows with its requests and the verdicts that they change, not with what is
stored. Only new and changed verdicts are written, under the number of their batch.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from docweave.operators.events import MICROS, REQUESTS_PER_WINDOW, WINDOW_SECONDS
from docweave.operators.relational import latest_by_key
from docweave.session import scratch

VERDICTS = "event_id bigint, client_id bigint, us bigint, admitted boolean"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _processor(seconds: int, limit: int, keep_slots: int | None) -> StatefulProcessor:
    """Made here, so that workers get the class itself and need not import this package."""
    span, row = seconds * MICROS, "<qq?"  # a request in the state: its time, its number, whether it passed

    def judge(requests: list, before: list[int]) -> list[tuple[int, int, bool]]:
        """Verdicts on a slot's requests in order; ``before``: the admitted times of the slot before."""
        admitted, first, out = list(before), 0, []
        for us, number, _ in requests:
            while first < len(admitted) and admitted[first] <= us - span:
                first += 1
            ok = len(admitted) - first < limit
            if ok:
                admitted.append(us)
            out.append((us, number, ok))
        return out

    class Limiter(StatefulProcessor):
        def init(self, handle) -> None:
            self.slots = handle.getMapState("slots", "slot bigint", "requests binary")
            self.newest = handle.getValueState("newest", "slot bigint")

        def load(self, slot: int) -> list:
            if not self.slots.containsKey((slot,)):
                return []
            return list(struct.iter_unpack(row, bytes(self.slots.getValue((slot,))[0])))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            new: dict[int, list] = {}
            for frame in rows:
                for us, number in zip(frame["us"].tolist(), frame["event_id"].tolist()):
                    new.setdefault(us // span, []).append((us, number, None))
            newest = max(new)
            if self.newest.exists():
                newest = max(newest, self.newest.get()[0])
            self.newest.update((newest,))
            changed = []
            waiting = sorted(new, reverse=True)
            at, before_slot, before = None, None, []
            while waiting or at is not None:
                if at is None or (waiting and waiting[-1] <= at):
                    at = waiting.pop()
                old = self.load(at)
                if not old and at not in new:
                    at = None
                    continue
                if before_slot != at - 1:
                    before = [us for us, _, ok in self.load(at - 1) if ok]
                merged = sorted(old + new.get(at, []), key=lambda r: r[:2])
                judged = judge(merged, before)
                changed += [new_row for old_row, new_row in zip(merged, judged) if old_row[2] is not new_row[2]]
                if judged != old:
                    self.slots.updateValue((at,), (b"".join(struct.pack(row, *r) for r in judged),))
                before_slot, before = at, [us for us, _, ok in judged if ok]
                # The next slot is judged again only if it sees other admitted ones than before.
                at = at + 1 if before != [us for us, _, ok in old if ok] else None
            if keep_slots is not None:
                old_slots = [s for (s,) in self.slots.keys() if s < newest - keep_slots]
                for slot in old_slots:
                    self.slots.removeKey((slot,))
            if changed:
                us, numbers, verdicts = zip(*changed)
                yield pd.DataFrame({"event_id": numbers, "client_id": key[0], "us": us, "admitted": verdicts})

        def close(self) -> None:
            pass

    return Limiter()


def limit_stream(
    stream: DataFrame,
    path: str | None = None,
    seconds: int = WINDOW_SECONDS,
    limit: int = REQUESTS_PER_WINDOW,
    keep_seconds: int | None = None,
) -> DataFrame:
    """Judge what has arrived in ``stream(event_id, client_id, ts)``; the verdicts so far.

    ``path`` holds the state and the verdicts; the next call on it goes on where the last one ended or
    was lost. Without a path the call stands alone. With ``keep_seconds`` requests older than that are
    forgotten, client by client, and a later one is judged without them.
    """
    spark = stream.sparkSession
    path = path or scratch(spark, "limiter")
    keep_slots = None if keep_seconds is None else -(-keep_seconds // seconds)
    rows = stream.select("client_id", "event_id", F.unix_micros("ts").alias("us"))
    judged = rows.groupBy("client_id").transformWithStateInPandas(
        _processor(seconds, limit, keep_slots), outputStructType=VERDICTS, outputMode="Update", timeMode="None"
    )

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/verdicts/batch={number}")

    known = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        query = (
            judged.writeStream.foreachBatch(write)
            .outputMode("update")
            .option("checkpointLocation", f"{path}/state")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        if known is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, known)
    return verdicts(stream, path)


def verdicts(stream: DataFrame, path: str) -> DataFrame:
    """``(event_id, client_id, ts, admitted)``: the last verdict on every request so far."""
    from docweave.sources.stored import folders

    spark = stream.sparkSession
    if not folders(spark, f"{path}/verdicts"):
        return spark.createDataFrame([], "event_id bigint, client_id bigint, ts timestamp, admitted boolean")
    rows = spark.read.schema(f"{VERDICTS}, batch bigint").parquet(f"{path}/verdicts")
    return latest_by_key(rows, ["event_id", "us"], ["batch"]).select(
        "event_id", "client_id", F.timestamp_micros("us").alias("ts"), "admitted"
    )
