"""Readers, stored runs, models, and every registered query on the smallest tables."""

import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tools.check import TABLES, rows_of
from docweave.operators import ml
from docweave.plans import process
from docweave.plans.store import STAGES, TABLES as RUN_TABLES, RunStore
from docweave.session import scratch
from docweave.sources import derived, files, sinks
from docweave.sources.stored import folders
from tests.conftest import DATA


def png(pixels: np.ndarray) -> bytes:
    """A gray PNG of a two-dimensional array."""

    def part(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + bytes(r.tolist()) for r in pixels)
    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def test_read_text_binary_and_images(spark, tmp_path):
    (tmp_path / "a.txt").write_text("first\nsecond", encoding="utf-8")
    pixels = np.zeros((6, 5), np.uint8)
    pixels[2:, :] = 200
    (tmp_path / "b.png").write_bytes(png(pixels))
    got = files.read_text_documents(spark, str(tmp_path / "*.txt")).first()
    assert (got.text, got.method, got.confidence) == ("first\nsecond", "direct_read", 1.0)
    listed = {r.name.rsplit("/", 1)[1]: (r.size, r.content_type) for r in files.list_files(spark, str(tmp_path)).collect()}
    assert listed == {"a.txt": (12, "text/plain"), "b.png": (len(png(pixels)), "image/png")}
    read = files.read_images(spark, str(tmp_path / "b.png"))
    assert read.select("height", "width").first() == (6, 5)


def test_documents_as_files(spark, tmp_path):
    texts = {1: "a\nb\n", 2: "é\U0001f600\r\n", 3: "x" * 100_000, 4: "\n", 5: None, 6: ""}
    df = spark.createDataFrame(list(texts.items()), "document_id long, text string").repartition(3)
    files.write_documents(df, str(tmp_path / "d"), folders=2)
    got = {int(r.document_id): (r.length, bytes(r.content)) for r in files.read_stored_documents(spark, str(tmp_path / "d")).collect()}
    assert got == {i: (len(t.encode()), t.encode()) for i, t in texts.items() if t}


def test_runs_are_whole_or_not_there(spark, tmp_path):
    rows = [(i, f"in/{i}{'.exe' if i == 3 else '.txt'}", 10, f"Invoice #INV-{i} total $5.00 mail a{i}@b.com call 555-123-4567") for i in range(6)]
    df = spark.createDataFrame(rows, "document_id long, path string, size long, text string")
    store = RunStore(spark, str(tmp_path / "s"))
    with pytest.raises(FileNotFoundError):
        store.read("documents")
    lost = F.struct(F.raise_error(F.lit("lost")).cast("boolean").alias("success"), F.lit("").alias("error"))
    broken = [STAGES[0], STAGES[1], ("storing", [*process.REGISTRY[8:10], ("cleanup", lambda d: d.withColumn("cleanup", lost))])]
    with pytest.raises(Exception, match="lost"):
        store.run(df, "one", broken)
    assert store.committed() == []
    kept = [f for f in folders(spark, f"{store.base}/runs/one") if not f.endswith("-rows")]
    store.run(df.where("false"), "one")  # goes on with the stages that are there, not with other files
    assert kept == ["0-intake", "1-analysis"] and store.committed() == ["one"] and not folders(spark, f"{store.base}/runs")
    tables = lambda: {t: sorted(map(repr, store.read(t).collect())) for t in RUN_TABLES}
    before = tables()
    assert [len(before[t]) for t in ("documents", "summary")] == [5, 6] and len(before["entities"]) >= 15
    logs = store.read("logs").where("document_id = 0")
    assert logs.count() == 11 and logs.where("processing_time > 0 AND created_at IS NOT NULL").count() == 11
    store.run(df, "one")
    assert tables() == before
    store.run(df.where("document_id = 1").withColumn("text", F.lit("Dear reader, nothing to be found here")), "two")
    assert store.read("entities").where("document_id = 1").count() == 0 and store.read("documents").count() == 5
    assert {r.run for r in store.read("summary").where("document_id = 1").collect()} == {"two"}
    spark.range(1).write.parquet(f"{store.base}/tables/logs/run=half")
    assert store.cleanup() == [f"{store.base}/tables/logs/run=half"] and store.read("logs").where("run = 'half'").count() == 0


def test_requests(spark):
    bodies = [(1, '{"texts": ["a", "b"], "options": {"batch_size": 5}}'), (2, '{"texts": "a"}'), (3, "{}"), (4, "{nope")]
    df = spark.createDataFrame(bodies, "request_id long, body string")
    got = {r.request_id: r.error for r in files.parse_batch_requests(df).collect()}
    assert got == {1: None, 2: "Texts must be a list", 3: "No texts provided", 4: "No JSON data provided"}
    items = files.request_items(files.parse_batch_requests(df).where("error is null")).collect()
    assert [(r.position, r.text, r.batch_size) for r in items] == [(0, "a", 5), (1, "b", 5)]


def test_one_store_fails_alone(spark):
    good = spark.range(3)
    bad = spark.range(3).select(F.raise_error(F.lit("broken")).alias("x"))
    path = scratch(spark, "good")
    outcome = sinks.store_both({"bad": (bad, scratch(spark, "bad")), "good": (good, path)})
    assert outcome["good"] is None and outcome["bad"]
    assert spark.read.parquet(path).count() == 3


def test_models(spark, tmp_path):
    rows = [(i, "payment due invoice" if i % 2 else "parties sign agreement", "invoice" if i % 2 else "contract") for i in range(60)]
    df = ml.with_terms(spark.createDataFrame(rows, "document_id long, text string, label string"))
    model, metrics = ml.train(df, "document_id", ml.text_pipeline(features=64, iterations=10))
    assert metrics["accuracy"] == 1.0 and len(ml.history(model)) > 1
    first = ml.predict(model, df.drop("label"), "document_id")
    assert first.join(df, "document_id").where("predicted_class <> label").count() == 0
    second = first.where("document_id < 10")
    both = {r.document_id: r for r in ml.ensemble(first, second, "document_id", ml.labels_of(model)).collect()}
    assert len(both) == 60 and both[3].predicted_class == "invoice"
    model.write().overwrite().save(str(tmp_path / "m"))
    again = ml.predict(PipelineModel.load(str(tmp_path / "m")), df.drop("label"), "document_id")
    assert sorted(map(repr, again.collect())) == sorted(map(repr, first.collect()))
    assert ml.cluster(df, "document_id").select("cluster").distinct().count() <= 3


def test_entry_and_keys(spark):
    assert contract.entry(spark).limit(1).count() == 1
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


# Single patterns have tests of their own; models have no SQL, only their shape is looked at.
SQL = [q for q in contract.oracle_sql() if not q.startswith(("extract_", "fin_")) or q == "extract_and_predict"]
MODELS = ["train_classifier", "cluster_documents", "ensemble_align"]


@pytest.mark.parametrize("name", SQL)
def test_query_equals_its_sql(spark, duck, name):
    got = contract.queries()[name](spark, DATA)
    cursor = duck.execute(contract.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, got.collect()) == rows_of(names, cursor.fetchall())


@pytest.mark.parametrize("name", MODELS)
def test_model_query_covers_the_corpus(spark, name):
    got = contract.queries()[name](spark, DATA)
    ids = {r[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()}
    assert {r.document_id for r in got.collect()} == ids
    if name == "train_classifier":
        assert got.where("predicted_class NOT IN ('good', 'poor') OR confidence < 0.5 OR confidence > 1").count() == 0


def test_inputs_are_dealt_out_whatever_their_files_are(spark, tmp_path):
    path = str(tmp_path / "orders.parquet")
    spark.range(4000).selectExpr("id AS o_orderkey").coalesce(1).write.parquet(path)
    wanted = spark.conf.get("spark.docweave.inputPartitions")
    spark.conf.unset("spark.docweave.inputPartitions")
    try:
        rows = derived.source(spark, str(tmp_path), "orders")
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.docweave.inputPartitions", wanted)
    assert sum(sizes) == 4000
    assert len(sizes) >= 4 and max(sizes) < 1000


def test_stored_documents_are_looked_up_by_bucket(spark, tmp_path):
    """The driver looks up the buckets, not a folder for every document."""
    df = spark.range(200).selectExpr("id AS document_id", "concat('text ', id) AS text")
    files.write_documents(df, str(tmp_path / "d"), folders=3)
    read = files.read_stored_documents(spark, str(tmp_path / "d"))
    scan = read._jdf.queryExecution().optimizedPlan().collectLeaves().apply(0)
    assert scan.relation().location().rootPaths().size() == 3
    assert read.select("document_id").distinct().count() == 200


def test_documents_are_written_as_plain_files(spark, tmp_path):
    """No checksum files, which Hadoop's local file system adds (and runs a command for every file and folder);
    a second try of a task puts the same files in place of the first one's."""
    rows = [("a/b c", "one"), ("a/b c", "two\n"), ("a/b c", "two\n"), ("ä%", "drei"), (None, "none"), ("x", ""), ("y", None)]
    df = spark.createDataFrame(rows, "document_id string, text string")
    path = str(tmp_path / "d")
    files.write_documents(df, path, folders=2)
    names = sorted(p.relative_to(path) for p in (tmp_path / "d").rglob("*") if p.is_file())
    assert len(names) == 5 and all(n.name.startswith("part-") and n.suffix == ".txt" for n in names)
    assert {n.parts[1] for n in names} == {"document_id=a%2Fb c", "document_id=ä%25", "document_id=__HIVE_DEFAULT_PARTITION__"}
    whole = lambda: {n: (tmp_path / "d" / n).read_bytes() for n in names}
    first = whole()
    assert sorted(first.values()) == sorted((t + "\n").encode() for _, t in rows if t)
    (tmp_path / "d" / names[0]).with_name(".left").write_bytes(b"half")
    batch = lambda part: pa.RecordBatch.from_pylist(part, pa.schema([("bucket", "int32"), ("id", "string"), ("text", "binary")]))
    keys = [str(n.parent).split("=")[1].split("/")[0] for n in names if "a%2Fb c" in str(n)]
    again = [{"bucket": int(keys[0]), "id": "a/b c", "text": t.encode()} for i, t in sorted(rows[:3])]
    # The same rows in other batches.
    assert next(files._writer(path)(iter([batch(again[:1]), batch(again[1:])])))["files"].to_pylist() == [3]
    assert whole() == first
    assert files.read_stored_documents(spark, path).count() == 5
