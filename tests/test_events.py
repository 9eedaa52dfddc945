"""Rates, sessions and the limiter against loops; batch against stream; one client dominates."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from docweave.operators import events as ops
from docweave.operators import ocr, relational
from docweave.operators.skew import left_join_many, with_position
from docweave.session import scratch
from docweave.streaming import jobs, limiter

EPOCH = 1_704_067_200_000_000


@pytest.fixture(scope="module")
def history():
    """Bursts, pauses, equal stamps, exact window borders; client 1 holds most rows."""
    rng, rows, clock = random.Random(3), [], defaultdict(lambda: EPOCH)
    for i in range(3000):
        client = 1 if rng.random() < 0.6 else rng.randint(2, 6)
        clock[client] += rng.choice([0, 1, 500_000, 1_000_000, 5_000_000, 60_000_000, 59_999_999, 120_000_000])
        rows.append((i, client, clock[client]))
    return rows


@pytest.fixture(scope="module")
def events(spark, history):
    df = spark.createDataFrame(history, "event_id long, client_id long, us long")
    return df.select("event_id", "client_id", F.timestamp_micros("us").alias("ts")).repartition(5)


def by_client(history):
    out = defaultdict(list)
    for i, c, us in sorted(history, key=lambda r: (r[2], r[0])):
        out[c].append((i, us))
    return out


def test_preceding_counts(history, events):
    got = {r.event_id: r.recent for r in ops.preceding_counts(events).collect()}
    assert len(got) == len(history)
    for rows in by_client(history).values():
        for i, us in rows:
            assert got[i] == sum(us - 60_000_000 < v < us for _, v in rows)


def test_gap_sessions(history, events):
    want = []
    for c, rows in by_client(history).items():
        start = last = rows[0][1]
        n = 0
        for _, us in rows:
            if us - last >= 60_000_000:
                want.append((c, start, last, n))
                start, n = us, 0
            last, n = us, n + 1
        want.append((c, start, last, n))
    got = ops.gap_sessions(events, 60).select("client_id", "start_us", "end_us", "events").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def admitted(history, limit, span):
    out = {}
    for rows in by_client(history).values():
        kept = deque()
        for i, us in rows:
            while kept and kept[0] <= us - span:
                kept.popleft()
            out[i] = len(kept) < limit
            if out[i]:
                kept.append(us)
    return out


@pytest.mark.parametrize("limit", [1, 3, 8])
def test_limiter_equals_loop(history, events, limit):
    got = {r.event_id: r.admitted for r in ops.limit_requests(events, limit=limit).collect()}
    want = admitted(history, limit, 60_000_000)
    assert got == want and not all(want.values())


@pytest.fixture(scope="module")
def late_files(spark, history):
    """The same requests in three files, the newest first."""
    path = scratch(spark, "late-input")
    df = spark.createDataFrame(history, "event_id long, client_id long, us long").select(
        "event_id", "client_id", F.timestamp_micros("us").alias("ts")
    )
    stamps = sorted(us for _, _, us in history)
    cuts = [stamps[0], stamps[len(stamps) // 3], stamps[2 * len(stamps) // 3], stamps[-1] + 1]
    for low, high in reversed(list(zip(cuts, cuts[1:]))):
        part = F.unix_micros("ts").between(low, high - 1)
        df.where(part).coalesce(1).write.mode("append").parquet(path)
    return path, df


def test_limiter_stream_equals_batch(spark, history, late_files):
    path, df = late_files
    stream = jobs.read_stream(spark, path, df.schema, files_per_trigger=1)
    got = {r.event_id: r.admitted for r in limiter.limit_stream(stream, limit=3).collect()}
    assert got == admitted(history, 3, 60_000_000)


def shuffled_files(spark, history, parts=6):
    """The requests in files that hold rows of all times."""
    path = scratch(spark, "mixed-input")
    df = spark.createDataFrame(history, "event_id long, client_id long, us long").select(
        "event_id", "client_id", F.timestamp_micros("us").alias("ts")
    )
    return path, [df.where(F.pmod(F.xxhash64("event_id"), F.lit(parts)) == i).coalesce(1) for i in range(parts)], df


def test_limiter_goes_on_where_it_ended(spark, history):
    """Two calls on one path, files between them; a batch writes only what is new or has changed."""
    source, files, df = shuffled_files(spark, history)
    state = scratch(spark, "limiter-state")
    for half in (files[:3], files[3:]):
        for f in half:
            f.write.mode("append").parquet(source)
        stream = jobs.read_stream(spark, source, df.schema, files_per_trigger=1)
        got = limiter.limit_stream(stream, state, limit=3)
    want = admitted(history, 3, 60_000_000)
    assert {r.event_id: r.admitted for r in got.collect()} == want
    written = spark.read.parquet(f"{state}/verdicts")
    assert len(want) < written.count() < 2 * len(want) and written.select("batch").distinct().count() >= 6
    again = limiter.limit_stream(jobs.read_stream(spark, source, df.schema), state, limit=3)
    assert again.count() == len(want) and spark.read.parquet(f"{state}/verdicts").count() == written.count()


def test_limiter_forgets(spark):
    """With a bound on what is kept, old requests neither stay in the state nor block late ones."""
    path, state = scratch(spark, "old-input"), scratch(spark, "old-state")
    rows = [[(i, 1, EPOCH + i * 1000) for i in range(3)], [(9, 1, EPOCH + 10**10)], [(10, 1, EPOCH + 5000)]]
    for part in rows:
        df = spark.createDataFrame(part, "event_id long, client_id long, us long").select("event_id", "client_id", F.timestamp_micros("us").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(path)
        got = limiter.limit_stream(jobs.read_stream(spark, path, df.schema), state, limit=3, keep_seconds=600)
    assert {r.event_id: r.admitted for r in got.collect()} == {0: True, 1: True, 2: True, 9: True, 10: True}


def test_late_rows_count_in_windows_and_sessions(spark, late_files):
    path, df = late_files
    stream = lambda: jobs.read_stream(spark, path, df.schema, files_per_trigger=1)
    windows = jobs.rate_windows(stream())
    assert sorted(map(tuple, windows.collect())) == sorted(map(tuple, ops.window_counts(df).collect()))
    live = jobs.sessions(stream(), seconds=60)
    got = sorted((r.client_id, r.s, r.e - 60_000_000, r.events) for r in live.select("client_id", F.unix_micros("start").alias("s"), F.unix_micros("end").alias("e"), "events").collect())
    want = sorted((r.client_id, r.start_us, r.end_us, r.events) for r in ops.gap_sessions(df, 60).collect())
    assert got == want


def test_streams_go_on_after_a_lost_batch(spark, history):
    """A batch that dies after its write is run again; folders are merged, and those merged are removed."""
    source, files, df = shuffled_files(spark, history, 7)
    state = scratch(spark, "sessions-state")
    partial = lambda batch: ops.gap_sessions(batch, 60).drop("session")
    broken = {"left": 2}

    def merge(parts):
        if broken["left"]:
            broken["left"] -= 1
            raise RuntimeError("lost")
        return ops.merge_sessions(parts, 60)

    want = sorted((r.client_id, r.start_us, r.end_us, r.events) for r in ops.gap_sessions(df, 60).collect())
    for number, f in enumerate(files):
        f.write.mode("append").parquet(source)
        for _ in range(4):
            stream = jobs.read_stream(spark, source, df.schema, files_per_trigger=1)
            try:
                got = jobs.accumulate(stream, partial, merge, state, compact_every=2)
                break
            except Exception as lost:
                assert "lost" in str(lost)
        assert broken["left"] == 0 or number == 0
    assert sorted(map(tuple, got.select("client_id", "start_us", "end_us", "events").collect())) == want
    from docweave.sources.stored import folders

    assert len(folders(spark, f"{state}/merged")) <= 2 and len(folders(spark, f"{state}/parts")) <= 4
    first = spark.read.parquet(f"{state}/parts/{folders(spark, f'{state}/parts')[0]}")
    assert first.count() < len(want) * 2


def test_empty_streams(spark):
    df = spark.createDataFrame([], "event_id long, client_id long, ts timestamp")
    path = scratch(spark, "empty-input")
    df.write.parquet(path)
    stream = lambda: jobs.read_stream(spark, path, df.schema)
    assert jobs.rate_windows(stream()).count() == jobs.sessions(stream()).count() == limiter.limit_stream(stream()).count() == 0


def test_rates_are_linear_in_a_hot_window(spark):
    """Forty thousand requests of one client inside one window; a frame per row would take minutes."""
    df = spark.range(40_000).select(F.col("id").alias("event_id"), F.lit(1).alias("client_id"), F.timestamp_micros(EPOCH + F.col("id")).alias("ts"))
    got = ops.preceding_counts(df).agg(F.sum("recent"), F.max("recent")).first()
    assert tuple(got) == (40_000 * 39_999 // 2, 39_999)


def test_ingest_writes_what_batch_computes(spark):
    source, target = scratch(spark, "texts"), scratch(spark, "stored")
    df = spark.createDataFrame([(i, f"mail {i}@x.com") for i in range(20)], "document_id long, text string")
    df.repartition(4).write.parquet(source)
    stream = jobs.read_stream(spark, source, df.schema, files_per_trigger=2)
    jobs.ingest(
        stream, lambda d: d.withColumn("n", F.length("text")), {"a": lambda d: d.select("document_id", "n")}, target, scratch(spark, "state")
    ).awaitTermination()
    got = spark.read.parquet(f"{target}/a").select("document_id", "n")
    assert sorted(map(tuple, got.collect())) == sorted((i, len(f"mail {i}@x.com")) for i in range(20))


def test_positions(spark):
    rows = [(c, t) for c in range(7) for t in range(1 if c else 5000)]
    df = spark.createDataFrame(rows, "conv long, turn long").repartition(6)
    pieces = [F.floor(F.col("conv") / 3), F.col("conv"), F.floor(F.col("turn") / 100)]
    got = with_position(df, ["turn"], pieces)
    assert [(r.conv, r.turn) for r in got.orderBy("position").collect()] == sorted(rows)
    assert got.agg(F.min("position"), F.max("position")).first() == (0, len(rows) - 1)


def test_left_join_many(spark):
    parent = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "document_id long, p string")
    child = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z"), (9, "q")], "document_id long, k string")
    got = sorted(map(tuple, left_join_many(parent, child, "document_id").collect()), key=repr)
    assert got == sorted(map(tuple, parent.join(child, "document_id", "left").collect()), key=repr)


def test_ids_are_exact_not_prefixes(spark):
    docs = spark.createDataFrame([("1",), ("2",)], "document_id string")
    files = spark.createDataFrame([("documents/10.txt",), ("documents/1.pdf",), ("processed/1_results.json",)], "name string")
    got = relational.document_files(docs, files).select("document_id", "name", "found").collect()
    assert sorted(map(tuple, got), key=repr) == [
        ("1", "documents/1.pdf", True), ("1", "processed/1_results.json", True), ("2", None, False),
    ]


def test_pages_and_engines(spark):
    pages = spark.createDataFrame(
        [(1, 2, "tesseract", "b", 80.0), (1, 1, "tesseract", "a", 60.0), (1, 3, "tesseract", "", 0.0),
         (1, 1, "google_vision", "A", 60.0), (1, 2, "google_vision", "B", 0.5), (1, 3, "google_vision", "C", 0.51),
         (2, 1, "tesseract", None, None)],
        "document_id long, page int, engine string, text string, confidence double",
    )
    joined = {r.document_id: (r.text, r.confidence, r.pages) for r in ocr.join_pages(pages.where("engine = 'tesseract'")).collect()}
    assert joined == {1: ("a\nb", 140 / 3, 3), 2: ("", 0.0, 1)}
    best = {(r.document_id, r.page): r.engine for r in ocr.best_engine(pages).collect()}
    assert best == {(1, 1): "tesseract", (1, 2): "tesseract", (1, 3): "google_vision", (2, 1): "tesseract"}
    fall = {(r.document_id, r.page): r.text for r in ocr.fallback_engine(pages).collect()}
    assert fall == {(1, 1): "A", (1, 2): "b", (1, 3): "C", (2, 1): None}
