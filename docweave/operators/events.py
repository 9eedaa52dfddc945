"""Request events: rates, sessions and the exact limiter, safe for one client that dominates.

``events(client_id, ts)`` with ``ts`` a TIMESTAMP. Nothing here sorts the whole history of a client
in one task unless the result itself is a chain through it (see ``limit_requests``).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

MICROS = 1_000_000
# The limiter's window and limit, and how long a session lasts.
WINDOW_SECONDS = 60
REQUESTS_PER_WINDOW = 60
SESSION_SECONDS = 3600


def preceding_counts(
    events: DataFrame,
    id_col: str = "event_id",
    seconds: int = WINDOW_SECONDS,
    piece: int = 10,
    with_peers: bool = False,
) -> DataFrame:
    """``recent``: requests of the same client in the ``seconds`` before each one.

    ``with_peers`` counts the request itself and those at the very same instant too. A client's
    history is cut into pieces of ``piece`` windows. Each event is counted in its own piece; those of
    a piece's last window are handed to the next piece as well, where they count but do not appear.
    Inside a piece every request adds one at its time and takes it off again a window later, so two
    running sums give the number, and the work is linear in the requests however many a window holds.
    """
    span, width = seconds * MICROS, piece * seconds * MICROS
    us = F.unix_micros("ts")
    own = F.floor(us / width)
    in_tail = F.pmod(us, F.lit(width)) >= width - span
    pieces = F.when(in_tail, F.array(own, own + 1)).otherwise(F.array(own))
    spread = events.select(
        id_col, "client_id", "ts", us.alias("_us"), F.explode(pieces).alias("_piece")
    )
    change = F.array(
        F.struct(F.col("_us").alias("_at"), F.lit(1).alias("_step")),
        F.struct((F.col("_us") + span).alias("_at"), F.lit(-1).alias("_step")),
    )
    changes = spread.select("*", F.inline(change))
    in_order = W.Window.partitionBy("client_id", "_piece").orderBy("_at")
    so_far = in_order.rangeBetween(W.Window.unboundedPreceding, 0)
    earlier = so_far if with_peers else in_order.rangeBetween(W.Window.unboundedPreceding, -1)
    come = F.coalesce(F.sum(F.when(F.col("_step") > 0, 1)).over(earlier), F.lit(0))
    gone = F.coalesce(F.sum(F.when(F.col("_step") < 0, 1)).over(so_far), F.lit(0))
    return (
        changes.withColumn("recent", (come - gone).cast("bigint"))
        .where((F.col("_step") > 0) & (F.col("_piece") == F.floor(F.col("_us") / width)))
        .drop("_piece", "_us", "_at", "_step")
    )


def gap_sessions(events: DataFrame, seconds: int = SESSION_SECONDS) -> DataFrame:
    """Sessions of a client: a pause of ``seconds`` or more starts a new one.

    Two events in one time slot as long as the pause are always in the same session, so events are
    first reduced to one row per client and slot, before the shuffle. The window function then sees
    at most one row per slot of the calendar, however many events a client has.
    """
    gap = seconds * MICROS
    us = F.unix_micros("ts")
    slots = events.groupBy("client_id", F.floor(us / gap).alias("_slot")).agg(
        F.min(us).alias("_first"), F.max(us).alias("_last"), F.count("*").alias("_n")
    )
    by_time = W.Window.partitionBy("client_id").orderBy("_slot")
    fresh = F.coalesce(F.col("_first") - F.lag("_last").over(by_time) >= gap, F.lit(True))
    return (
        slots.withColumn("_new", fresh.cast("int"))
        .withColumn("session", F.sum("_new").over(by_time))
        .groupBy("client_id", "session")
        .agg(
            F.min("_first").alias("start_us"),
            F.max("_last").alias("end_us"),
            F.sum("_n").alias("events"),
        )
    )


def merge_sessions(sessions: DataFrame, seconds: int = SESSION_SECONDS) -> DataFrame:
    """Sessions ``(client_id, start_us, end_us, events)`` of several sources, as if found in one.

    Those of a client that overlap, or lie less than the pause apart, become one. A source has at most one
    session of a client per slot of the calendar, which bounds the rows of the window.
    """
    gap = seconds * MICROS
    by_start = W.Window.partitionBy("client_id").orderBy("start_us", "end_us")
    reach = F.max("end_us").over(by_start.rowsBetween(W.Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("start_us") - reach >= gap, F.lit(True))
    return (
        sessions.withColumn("_new", fresh.cast("int"))
        .withColumn("_session", F.sum("_new").over(by_start.rowsBetween(W.Window.unboundedPreceding, 0)))
        .groupBy("client_id", "_session")
        .agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("events").alias("events"))
        .drop("_session")
    )


def window_counts(events: DataFrame, seconds: int = WINDOW_SECONDS, slide: int = 10) -> DataFrame:
    """Requests per client and sliding window (the approximate limiter)."""
    return (
        events.groupBy("client_id", F.window("ts", f"{seconds} seconds", f"{slide} seconds").alias("w"))
        .agg(F.count("*").alias("requests"))
        .select("client_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "requests")
    )


def _fold(seconds: int, limit: int):
    """Sequential admission over rows sorted by chain and time; holds ``limit`` stamps at most."""
    span = seconds * MICROS

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, admitted = None, deque()
        for frame in frames:
            verdicts = []
            keys = zip(frame["client_id"], frame["_chain"], strict=True)
            for key, us in zip(keys, frame["_us"], strict=True):
                if key != chain:
                    chain = key
                    admitted.clear()
                while admitted and admitted[0] <= us - span:
                    admitted.popleft()
                ok = len(admitted) < limit
                if ok:
                    admitted.append(us)
                verdicts.append(ok)
            yield frame.assign(admitted=verdicts)

    return run


def limit_requests(
    events: DataFrame,
    id_col: str = "event_id",
    seconds: int = WINDOW_SECONDS,
    limit: int = REQUESTS_PER_WINDOW,
) -> DataFrame:
    """Exact limiter: a request passes if fewer than ``limit`` *admitted* ones are less than
    ``seconds`` old; refused requests leave no trace.

    A refusal needs ``limit`` earlier requests within the window, admitted or not. Where a client
    stays below that for a whole window, every request of that window passes and what went before no
    longer matters. So only *busy spells* are sequential: runs of requests with ``limit`` or more
    before them, with less than one window between two of them, plus the window that leads in. Each
    spell is a chain of its own and spells are spread over the tasks; everything outside them is
    admitted without sorting. Inside a spell the fold streams over sorted rows and keeps ``limit``
    stamps. A client that exceeds the limit without a pause is one long chain by definition.
    """
    span = seconds * MICROS
    us = F.unix_micros("ts")
    busy = preceding_counts(events, id_col, seconds, with_peers=True).where(F.col("recent") > limit)
    spells = gap_sessions(busy.select("client_id", "ts"), seconds).select(
        "client_id",
        F.col("session").alias("chain"),
        (F.col("start_us") - span + 1).alias("from_us"),
        F.col("end_us").alias("to_us"),
    )
    # Rows find their spell by equality on the window-long slots that it touches. Spells are at
    # least a window apart, so a slot holds three at most and the list stays short.
    touched = F.sequence(F.floor(F.col("from_us") / span), F.floor(F.col("to_us") / span))
    by_slot = (
        spells.withColumn("_slot", F.explode(touched))
        .groupBy("client_id", "_slot")
        .agg(F.collect_list(F.struct("chain", "from_us", "to_us")).alias("_spells"))
    )
    rows = events.select(id_col, "client_id", "ts", us.alias("_us"), F.floor(us / span).alias("_slot"))
    inside = F.filter("_spells", lambda s: F.col("_us").between(s["from_us"], s["to_us"]))
    marked = (
        rows.join(by_slot, ["client_id", "_slot"], "left")
        .withColumn("_chain", F.get(inside, F.lit(0))["chain"])
        .drop("_slot", "_spells")
    )
    free = marked.where(F.col("_chain").isNull()).select(
        id_col, "client_id", "ts", F.lit(True).alias("admitted")
    )
    chained = (
        marked.where(F.col("_chain").isNotNull())
        .repartition("client_id", "_chain")
        .sortWithinPartitions("client_id", "_chain", "_us", id_col)
    )
    schema = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in chained.schema.fields
    ) + ", admitted boolean"
    folded = chained.mapInPandas(_fold(seconds, limit), schema).select(
        id_col, "client_id", "ts", "admitted"
    )
    return free.unionByName(folded)
