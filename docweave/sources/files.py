"""Readers: text, binary, image, JSON requests, training channels, named datasets."""

from __future__ import annotations

import os
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.files import mime_type

# Spark's text writer ends every row with a mark.
END_OF_FILE = "\n"

BATCH_REQUEST = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("texts", T.ArrayType(T.StringType())),
        T.StructField(
            "options",
            T.StructType(
                [
                    T.StructField("batch_size", T.IntegerType()),
                    T.StructField("filter_high_confidence", T.BooleanType()),
                ]
            ),
        ),
    ]
)


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: ``(path, text, method, confidence)``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("value").alias("text"),
        F.lit("direct_read").alias("method"),
        F.lit(1.0).alias("confidence"),
    )


def read_binary_documents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Bytes of PDF, image and office files with their file facts."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def write_documents(df: DataFrame, path: str, folders: int = 256) -> None:
    """Every text of ``df(document_id, text)`` to a file of its own: ``bucket=…/document_id=…/…``.

    The files hold the texts' bytes and one line end. Null and empty texts get no file; texts of one id
    lie in one folder. Buckets keep listings short; a task writes the documents of its buckets one by one,
    and there are as many tasks as buckets, as opening a file takes longer than filling it. On a file system
    that is mounted, the files are written as such: Hadoop's local one runs ``chmod`` for each file and folder.
    """
    bucket = F.pmod(F.xxhash64("document_id"), F.lit(folders)).alias("bucket")
    some = df.where("text <> ''").select(bucket, "document_id", "text")
    spread = some.repartition(folders, "bucket").sortWithinPartitions("bucket", "document_id", "text")
    mounted = _mounted(df.sparkSession, path)
    if mounted is None:
        spread.write.partitionBy("bucket", "document_id").option("lineSep", END_OF_FILE).text(path)
        return
    os.makedirs(mounted)
    rows = spread.select("bucket", F.col("document_id").cast("string"), F.col("text").cast("binary"))
    rows.mapInArrow(_writer(mounted), "files long").agg(F.sum("files")).collect()


def _mounted(spark: SparkSession, path: str) -> str | None:
    """The folder that ``path`` is on this machine; none if it lies elsewhere."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


_ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")  # in a folder's name, as Spark does


def _writer(path: str):
    """Writes rows (bucket, document_id, text), sorted by these; tells how many. A file appears whole, under a name
    that follows from the rows alone: what a task leaves behind, its next try replaces."""

    def run(batches):
        files, before, made, attempt = 0, None, None, uuid.uuid4().hex
        for batch in batches:
            for *key, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                number = number + 1 if key == before else 0
                before = key
                name = _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", key[1] or "") or "__HIVE_DEFAULT_PARTITION__"
                folder = f"{path}/bucket={key[0]}/document_id={name}"
                if folder != made:
                    os.makedirs(folder, exist_ok=True)
                    made = folder
                whole = f"{folder}/part-{number:05d}.txt"
                with open(f"{folder}/.{attempt}", "wb") as out:
                    out.write(text + END_OF_FILE.encode())
                os.replace(out.name, whole)
                files += 1
        yield pa.RecordBatch.from_pydict({"files": [files]})

    return run


def read_stored_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(document_id, length, content)`` of files that ``write_documents`` has made; the mark at the end goes.

    Only the buckets are looked up by the driver; tasks list what lies below them, a bucket each.
    """
    end = len(END_OF_FILE.encode())
    name = F.regexp_extract("path", r"/document_id=([^/]*)/[^/]*\z", 1)
    length = F.col("length") - end
    content = F.substring(F.col("content"), F.lit(1), length.cast("int"))
    stored = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{path}/bucket=*")
    return stored.select(name.alias("document_id"), length.alias("length"), content.alias("content"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images: ``(path, height, width, nChannels, data)``."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select(
        F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data"
    )


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Name, size, type and time of stored files; the bytes are not read."""
    return read_binary_documents(spark, path, glob).select(
        F.col("path").alias("name"),
        F.col("length").alias("size"),
        mime_type(F.col("path")).alias("content_type"),
        F.col("modificationTime").alias("created"),
    )


def read_batch_requests(spark: SparkSession, path: str) -> DataFrame:
    """Batch requests with a column for lines that do not fit."""
    schema = T.StructType([*BATCH_REQUEST.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(schema).json(path)


def parse_batch_requests(df: DataFrame, body: str = "body") -> DataFrame:
    """JSON bodies to requests with an ``error``: unreadable, or no list of texts."""
    parsed = df.withColumn("r", F.from_json(body, BATCH_REQUEST))
    whole = F.try_parse_json(F.col(body))
    kind = F.schema_of_variant(F.try_variant_get(whole, "$.texts", "variant"))
    return parsed.select(
        *[c for c in df.columns if c != body],
        "r.texts",
        "r.options",
        F.when(whole.isNull(), "No JSON data provided")
        .when(kind.isNull(), "No texts provided")
        .when(~kind.startswith("ARRAY"), "Texts must be a list")
        .alias("error"),
    )


def request_items(requests: DataFrame, key: str = "request_id") -> DataFrame:
    """One row per text of a request."""
    size = F.coalesce("options.batch_size", F.lit(10))
    return requests.select(key, size.alias("batch_size"), F.posexplode("texts").alias("position", "text"))


def read_text_channels(spark: SparkSession, train: str, validation: str | None = None) -> DataFrame:
    """Training lines and, if given, validation lines, told apart by ``channel``."""
    out = spark.read.text(train).select(F.lit("train").alias("channel"), F.col("value").alias("text"))
    if validation:
        held = spark.read.text(validation)
        out = out.unionByName(held.select(F.lit("validation").alias("channel"), F.col("value").alias("text")))
    return out


def read_csv_channels(
    spark: SparkSession, schema: str | T.StructType, train: str, validation: str | None = None
) -> DataFrame:
    """The same for CSV; the schema is given, never inferred."""

    def one(path: str, channel: str) -> DataFrame:
        return spark.read.schema(schema).csv(path).withColumn("channel", F.lit(channel))

    out = one(train, "train")
    return out.unionByName(one(validation, "validation")) if validation else out


def register_dataset(spark: SparkSession, df: DataFrame, name: str, path: str, comment: str = "") -> DataFrame:
    """Keep a DataFrame under a name, with a description, at an explicit location.

    A table of that name gives way; its files stay where they are.
    """
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    df.write.mode("overwrite").option("path", path).format("parquet").saveAsTable(name)
    if comment:
        escaped = comment.replace("'", "''")
        spark.sql(f"COMMENT ON TABLE {name} IS '{escaped}'")
    return spark.table(name)


def apply_text_provider(files: DataFrame, provider, schema: str = "path string, text string, confidence double") -> DataFrame:
    """User hook: ``provider(bytes) -> (text, confidence)`` over file bytes, in Arrow batches."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            found = [provider(content) for content in frame["content"]]
            yield pd.DataFrame(
                {
                    "path": frame["path"],
                    "text": [t for t, _ in found],
                    "confidence": [float(c) for _, c in found],
                }
            )

    return files.select("path", "content").mapInPandas(run, schema)
