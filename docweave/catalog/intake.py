"""Reading, gates, routing, paths and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.catalog.registry import query, with_tables
from docweave.functions import files as fn
from docweave.functions.text import sentences
from docweave.operators import relational
from docweave.session import scratch
from docweave.sources import derived, files
from docweave.sources.tables import load

FILES = with_tables("files")
EXT = r"regexp_extract(name, '[^/.][^/]*?(\.[^./]*)$', 1)"
MIME = "CASE lower({0}) " + " ".join(f"WHEN '{e}' THEN '{m}'" for e, m in fn.MIME.items()) + " END"
SUPPORTED = "(" + ", ".join(f"'{e}'" for e in fn.SUPPORTED) + ")"


def listed(spark: SparkSession, base: str) -> DataFrame:
    """Derived files with ``created`` as a timestamp."""
    return derived.derive(spark, base, "files").withColumn("created", F.timestamp_micros("created_us"))


@query(
    "scan_text_docs",
    "SELECT doc_id AS document_id, text, 'direct_read' AS method, 1.0::DOUBLE AS confidence FROM documents",
)
def scan_text_docs(spark: SparkSession, base: str) -> DataFrame:
    return load(spark, base, "documents").select(
        F.col("doc_id").alias("document_id"), "text", F.lit("direct_read").alias("method"), F.lit(1.0).alias("confidence")
    )


@query(
    "scan_binary_docs",
    "SELECT doc_id AS document_id, strlen(text) AS length, sha256(text) AS digest FROM documents WHERE coalesce(text, '') <> ''",
)
def scan_binary_docs(spark: SparkSession, base: str) -> DataFrame:
    """Every document as a stored file of its own, read as bytes: size, and a digest of the content."""
    path = scratch(spark, "binary-docs")
    files.write_documents(derived.source(spark, base, "documents").withColumnRenamed("doc_id", "document_id"), path)
    return files.read_stored_documents(spark, path).select(
        F.col("document_id").cast("bigint").alias("document_id"), "length", F.sha2("content", 256).alias("digest")
    )


@query(
    "list_files",
    f"{FILES} SELECT name, size, {MIME.format(EXT)} AS content_type, created_us FROM files WHERE starts_with(name, 'documents/')",
)
def list_files(spark: SparkSession, base: str) -> DataFrame:
    """The whole listing of one prefix; a cap is the caller's choice."""
    return relational.listing(listed(spark, base), "documents/", None).select(
        "name", "size", fn.mime_type(F.col("name")).alias("content_type"), "created_us"
    )


@query(
    "filter_prefix",
    f"{FILES} SELECT name, size FROM files WHERE starts_with(name, 'processed/')",
)
def filter_prefix(spark: SparkSession, base: str) -> DataFrame:
    return relational.listing(listed(spark, base), "processed/", None).select("name", "size")


@query(
    "json_batch_scan",
    r"""SELECT conv_id || '-' || turn AS request_id, 10 AS batch_size, (i - 1)::INTEGER AS position, ss[i] AS text FROM (
SELECT conv_id, turn, ss, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT conv_id, turn,
list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS ss FROM conversations))""",
)
def json_batch_scan(spark: SparkSession, base: str) -> DataFrame:
    """Requests written as JSON lines, read back with a fixed schema, one row per text."""
    path = scratch(spark, "requests")
    turns = load(spark, base, "conversations")
    turns.select(
        F.concat_ws("-", "conv_id", "turn").alias("request_id"), sentences(F.col("text")).alias("texts")
    ).write.json(path)
    return files.request_items(files.read_batch_requests(spark, path))


@query(
    "validate_batch_input",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'No JSON data provided' WHEN 1 THEN 'No texts provided'
WHEN 2 THEN 'Texts must be a list' END AS error, CASE WHEN event_id % 4 = 3 THEN 2 END AS n_texts FROM events""",
)
def validate_batch_input(spark: SparkSession, base: str) -> DataFrame:
    """Bodies of four kinds: broken, without texts, with a single text, and as they should be."""
    kind = F.col("event_id") % 4
    body = (
        F.when(kind == 0, F.concat(F.lit('{"texts": ['), F.col("event_type")))
        .when(kind == 1, F.col("props"))
        .when(kind == 2, F.to_json(F.struct(F.col("event_type").alias("texts"))))
        .otherwise(F.to_json(F.struct(F.array("event_type", "props").alias("texts"))))
    )
    bodies = load(spark, base, "events").select("event_id", body.alias("body"))
    return files.parse_batch_requests(bodies).select(
        "event_id", "error", F.when(F.col("error").isNull(), F.size("texts")).alias("n_texts")
    )


@query(
    "train_source_text",
    r"""SELECT channel, line AS text, count(*) AS n FROM (
SELECT 'train' AS channel, unnest(string_split(text, chr(10))) AS line FROM documents
UNION ALL SELECT 'validation', unnest(string_split(text, chr(10))) FROM conversations) GROUP BY ALL""",
)
def train_source_text(spark: SparkSession, base: str) -> DataFrame:
    """Lines written as plain text and read back as a training and a validation channel."""
    train, held = scratch(spark, "train-text"), scratch(spark, "validation-text")
    load(spark, base, "documents").select("text").write.option("lineSep", "\n").text(train)
    load(spark, base, "conversations").select("text").write.option("lineSep", "\n").text(held)
    lines = files.read_text_channels(spark, train, held)
    return lines.groupBy("channel", "text").agg(F.count("*").alias("n"))


@query(
    "train_source_csv",
    """SELECT doc_id, quality, toxic, 'train' AS channel FROM labels WHERE doc_id % 5 <> 0
UNION ALL SELECT doc_id, quality, toxic, 'validation' FROM labels WHERE doc_id % 5 = 0""",
)
def train_source_csv(spark: SparkSession, base: str) -> DataFrame:
    train, held = scratch(spark, "train-csv"), scratch(spark, "validation-csv")
    labels = load(spark, base, "labels")
    labels.where("doc_id % 5 <> 0").write.csv(train)
    labels.where("doc_id % 5 = 0").write.csv(held)
    return files.read_csv_channels(spark, "doc_id bigint, quality int, toxic int", train, held)


@query("register_dataset", "SELECT channel, count(*) AS n FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN 'validation' ELSE 'train' END AS channel FROM labels) GROUP BY channel")
def register_dataset(spark: SparkSession, base: str) -> DataFrame:
    """A named table over an explicit location, read back by its name; another call takes its place."""
    channel = F.when(F.col("doc_id") % 5 == 0, "validation").otherwise("train")
    rows = load(spark, base, "labels").withColumn("channel", channel)
    table = files.register_dataset(spark, rows, "labels_by_channel", scratch(spark, "dataset"), "labels by channel")
    return table.groupBy("channel").agg(F.count("*").alias("n"))


@query(
    "filter_file_size",
    f"{FILES} SELECT name, size, CASE WHEN size > {fn.MAX_FILE_SIZE} THEN 'File too large' END AS error FROM files",
)
def filter_file_size(spark: SparkSession, base: str) -> DataFrame:
    return listed(spark, base).select("name", "size", fn.size_error(F.col("size")).alias("error"))


@query(
    "filter_file_type",
    f"{FILES} SELECT name, CASE WHEN lower({EXT}) NOT IN {SUPPORTED} THEN 'Unsupported file type: ' || lower({EXT}) END AS error FROM files",
)
def filter_file_type(spark: SparkSession, base: str) -> DataFrame:
    return listed(spark, base).select("name", fn.type_error(F.col("name")).alias("error"))


@query(
    "route_by_type",
    f"{FILES} SELECT name, CASE lower({EXT}) WHEN '.txt' THEN 'direct_read' WHEN '.pdf' THEN 'pdf_ocr' ELSE 'image_ocr' END AS method FROM files",
)
def route_by_type(spark: SparkSession, base: str) -> DataFrame:
    return listed(spark, base).select("name", fn.read_method(F.col("name")).alias("method"))


URL_EXT = EXT.replace("name", "url")


@query(
    "path_parts",
    rf"SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS basename, {URL_EXT} AS extension, {MIME.format(URL_EXT)} AS content_type FROM pages",
)
def path_parts(spark: SparkSession, base: str) -> DataFrame:
    url = F.col("url")
    return load(spark, base, "pages").select(
        "page_id",
        fn.basename(url).alias("basename"),
        fn.extension(url).alias("extension"),
        fn.mime_type(url).alias("content_type"),
    )


@query(
    "upload_meta",
    rf"{FILES} SELECT name, regexp_extract(name, '([^/]*)$', 1) AS blob_name, size, {MIME.format(EXT)} AS content_type FROM files",
)
def upload_meta(spark: SparkSession, base: str) -> DataFrame:
    """Destination (the base name by default), size and content type of an upload."""
    name = F.col("name")
    return listed(spark, base).select(
        "name", fn.basename(name).alias("blob_name"), "size", fn.mime_type(name).alias("content_type")
    )


@query(
    "store_path",
    rf"""{FILES} SELECT name, 'documents/' || 'id-' || size || {EXT} AS storage_path, 'id-' || size AS meta_id,
CASE WHEN size % 2 = 0 THEN 'given.txt' ELSE regexp_extract(name, '([^/]*)$', 1) END AS original_filename,
CASE WHEN size % 2 = 0 THEN 'caller' END AS owner FROM files""",
)
def store_path(spark: SparkSession, base: str) -> DataFrame:
    """Target path and metadata; what the caller gives replaces the defaults."""
    name = F.col("name")
    doc_id = F.concat(F.lit("id-"), F.col("size").cast("string"))
    own = F.create_map(F.lit("document_id"), doc_id, F.lit("original_filename"), fn.basename(name))
    given = F.when(
        F.col("size") % 2 == 0,
        F.create_map(F.lit("original_filename"), F.lit("given.txt"), F.lit("owner"), F.lit("caller")),
    )
    meta = fn.merge_metadata(own, given)
    return listed(spark, base).select(
        "name",
        fn.storage_path(doc_id, name).alias("storage_path"),
        meta["document_id"].alias("meta_id"),
        meta["original_filename"].alias("original_filename"),
        F.try_element_at(meta, F.lit("owner")).alias("owner"),
    )


@query(
    "map_merge",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN 'late' ELSE 'early' END AS phase, event_type AS kind,
CASE WHEN event_type = 'click' THEN 3 ELSE 2 END AS n_keys FROM events""",
)
def map_merge(spark: SparkSession, base: str) -> DataFrame:
    base_map = F.create_map(F.lit("phase"), F.lit("early"), F.lit("kind"), F.col("event_type"))
    extra = F.when(
        F.col("event_type") == "click", F.create_map(F.lit("phase"), F.lit("late"), F.lit("more"), F.lit("x"))
    )
    merged = fn.merge_metadata(base_map, extra)
    return load(spark, base, "events").select("event_id", merged.alias("m")).select(
        "event_id", F.col("m")["phase"].alias("phase"), F.col("m")["kind"].alias("kind"), F.size("m").alias("n_keys")
    )
