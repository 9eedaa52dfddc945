"""The stored tables, written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.catalog.analytics import typed
from docweave.catalog.extraction import found
from docweave.catalog.registry import query, with_tables
from docweave.catalog.textprep import documents
from docweave.functions.classify import document_type
from docweave.functions.entities import PATTERNS
from docweave.operators import entities as ents
from docweave.session import scratch
from docweave.sources import derived, sinks

DOCS = "WITH d AS (SELECT doc_id AS document_id, text, n_chars FROM documents)"
EVERY = " UNION ALL ".join(found(n, p, 0.9, source="d") for n, p in PATTERNS.items())


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write to the shared folder and read the table back."""
    spark = df.sparkSession
    path = scratch(spark, name)
    sinks.write_table(df, path, mode="overwrite", partition_by=partition_by)
    return spark.read.schema(df.schema).parquet(path)


def scored(spark: SparkSession, base: str) -> DataFrame:
    docs = derived.source(spark, base, "documents").withColumnRenamed("doc_id", "document_id")
    return docs.withColumn("t", document_type(F.col("text"))).select(
        "document_id", "text", "n_chars", "t.document_type", F.col("t.confidence").alias("confidence")
    )


@query(
    "sink_documents",
    f"""{DOCS} SELECT sha256('in/' || document_id || '.TXT') AS id, document_id || '.TXT' AS filename, '.txt' AS file_type, n_chars::INTEGER AS file_size,
'pending' AS processing_status, document_type, type_confidence AS confidence_score, text AS extracted_text, 1704067200000000 + document_id * 1000000 AS created_us FROM ({typed('d')})""",
)
def sink_documents(spark: SparkSession, base: str) -> DataFrame:
    rows = scored(spark, base).select(
        "document_id",
        F.concat(F.lit("in/"), F.col("document_id").cast("string"), F.lit(".TXT")).alias("path"),
        F.col("n_chars").alias("file_size"),
        "document_type",
        F.col("confidence").alias("confidence_score"),
        F.col("text").alias("extracted_text"),
    )
    created = F.timestamp_micros(F.lit(derived.EPOCH_US) + F.col("document_id") * 1_000_000)
    stored = written(sinks.document_rows(rows, created), "documents")
    return stored.withColumn("created_us", F.unix_micros("created_at")).drop("created_at")


@query(
    "sink_entities",
    f"""{DOCS}, e AS ({EVERY}),
r AS (SELECT document_id, upper(entity_type) AS t, text, confidence, start_position AS s, end_position AS e, 'unknown' AS m FROM e
  UNION ALL SELECT document_id, 'ORG', substr(text, 1, 5), 0.0, 0, 0, 'gazetteer' FROM d)
SELECT sha256(document_id || '|' || t || '|' || replace(text, '|', '||') || '|' || m || '|' || s || '|' || e) AS id, document_id, t AS entity_type, text AS entity_text, confidence::DOUBLE AS confidence_score,
s AS start_position, e AS end_position, m AS extraction_method FROM r""",
)
def sink_entities(spark: SparkSession, base: str) -> DataFrame:
    """Rows with and without type, offsets, confidence and method: the defaults fill the gaps."""
    matched = ents.extract(documents(spark, base)).select(
        "document_id", F.upper("entity_type").alias("label"), "text", "confidence", "start", "end"
    )
    names = documents(spark, base).select(
        "document_id", F.lit("ORG").alias("type"), F.substring("text", 1, 5).alias("text"), F.lit("gazetteer").alias("method")
    )
    mixed = matched.unionByName(names, allowMissingColumns=True)
    return written(sinks.entity_rows(mixed), "entities")


@query(
    "sink_predictions",
    f"""{DOCS} SELECT sha256(document_id || '|keywords|document_type') AS id, document_id, 'keywords' AS model_name, 'document_type' AS prediction_type,
document_type AS predicted_class, type_confidence AS confidence_score, document_type AS payload_type, n_chars AS payload_chars FROM ({typed('d')})""",
)
def sink_predictions(spark: SparkSession, base: str) -> DataFrame:
    df = scored(spark, base).withColumn("predicted_class", F.col("document_type"))
    rows = written(sinks.prediction_rows(df, "keywords", "document_type", ["document_type", "n_chars"]), "predictions")
    payload = F.from_json("prediction_data", "document_type string, n_chars bigint")
    return rows.withColumn("p", payload).select(
        "*", F.col("p.document_type").alias("payload_type"), F.col("p.n_chars").alias("payload_chars")
    ).drop("p", "prediction_data")


@query(
    "to_json_payload",
    f"{DOCS} SELECT document_id, document_type, type_confidence AS confidence, len(text) > 0 AS has_text FROM ({typed('d')})",
)
def to_json_payload(spark: SparkSession, base: str) -> DataFrame:
    """Nested result to JSON and back."""
    nested = F.struct("document_type", "confidence", F.struct((F.length("text") > 0).alias("has_text")).alias("facts"))
    as_json = scored(spark, base).select("document_id", F.to_json(nested).alias("j"))
    back = F.from_json("j", "document_type string, confidence double, facts struct<has_text:boolean>")
    return as_json.select("document_id", back.alias("r")).select(
        "document_id", "r.document_type", "r.confidence", "r.facts.has_text"
    )


@query(
    "sink_processing_logs",
    f"""{with_tables('step_logs')} SELECT document_id, step AS processing_step, CASE WHEN success THEN 'completed' ELSE 'failed' END AS status,
CASE WHEN NOT success THEN step || ' failed' END AS error_message, duration AS processing_time, epoch_us(timestamp) AS created_us FROM step_logs""",
)
def sink_processing_logs(spark: SparkSession, base: str) -> DataFrame:
    rows = written(sinks.log_rows(derived.derive(spark, base, "step_logs")), "processing-logs")
    return rows.withColumn("created_us", F.unix_micros("created_at")).drop("id", "created_at")


@query(
    "sink_content_store",
    f"""{DOCS} SELECT document_id, document_id || '.txt' AS filename, 'text/plain' AS content_type, strlen(text) AS raw_bytes, text AS extracted_text,
n_chars::VARCHAR AS meta_chars FROM d""",
)
def sink_content_store(spark: SparkSession, base: str) -> DataFrame:
    docs = scored(spark, base).withColumns(
        {"filename": F.concat(F.col("document_id").cast("string"), F.lit(".txt")), "content_type": F.lit("text/plain")}
    )
    meta = F.create_map(F.lit("chars"), F.col("n_chars").cast("string"))
    rows = written(sinks.content_rows(docs, meta), "content")
    return rows.select(
        "document_id",
        "filename",
        "content_type",
        F.octet_length("raw_content").cast("bigint").alias("raw_bytes"),
        "extracted_text",
        F.col("processing_metadata")["chars"].alias("meta_chars"),
    )


@query(
    "sink_analysis",
    f"""{DOCS} SELECT document_id, 'predictions' AS analysis_type, sha256(document_id || '|predictions') AS analysis_id, document_type AS result_type,
CASE WHEN document_id % 2 = 0 THEN type_confidence ELSE 0.0 END AS confidence_score FROM ({typed('d')})""",
)
def sink_analysis(spark: SparkSession, base: str) -> DataFrame:
    """One folder per kind of analysis; a missing confidence is 0.0."""
    given = F.when(F.col("document_id") % 2 == 0, F.col("confidence"))
    rows = sinks.analysis_rows(scored(spark, base), "predictions", ["document_type", "n_chars"], given)
    stored = written(rows, "analysis", ("analysis_type",))
    return stored.select(
        "document_id",
        "analysis_type",
        "analysis_id",
        F.get_json_object("results", "$.document_type").alias("result_type"),
        "confidence_score",
    )


@query(
    "sink_entity_store",
    f"""{DOCS}, e AS ({EVERY})
SELECT document_id, entity_type, sha256(document_id || '|' || entity_type || '|' || start_position || '|' || end_position || '|patterns') AS entity_id, text AS entity_text, confidence AS confidence_score,
start_position AS position_start, end_position AS position_end, 'patterns' AS extraction_method FROM e""",
)
def sink_entity_store(spark: SparkSession, base: str) -> DataFrame:
    rows = sinks.entity_store_rows(ents.extract(documents(spark, base)))
    placed = rows.repartition("document_id").sortWithinPartitions("document_id", "entity_type", "entity_id")
    stored = written(placed, "entity-store", ("entity_type",))
    return stored.withColumns(
        {"position_start": F.col("position_data")["start"], "position_end": F.col("position_data")["end"]}
    ).drop("position_data")


@query(
    "dual_sink",
    f"""{DOCS}, e AS (SELECT document_id, count(*) AS n FROM ({EVERY}) GROUP BY 1)
SELECT document_id, document_type, n_chars::VARCHAR AS meta_chars, coalesce(n, 0) AS entities, document_type AS analysed_type
FROM ({typed('d')}) LEFT JOIN e USING (document_id)""",
)
def dual_sink(spark: SparkSession, base: str) -> DataFrame:
    """Metadata and entities to one store, content and analysis to the other; then all joined by document."""
    done = scored(spark, base).withColumns({"filename": F.lit("f"), "content_type": F.lit("text/plain")}).persist()
    first, second = scratch(spark, "store-a"), scratch(spark, "store-b")
    meta = F.create_map(F.lit("chars"), F.col("n_chars").cast("string"))
    outcome = sinks.store_both(
        {
            "metadata": (done.select("document_id", "document_type", "confidence"), f"{first}/documents"),
            "entities": (sinks.entity_rows(ents.extract(done).withColumnRenamed("entity_type", "type")), f"{first}/entities"),
            "content": (sinks.content_rows(done, meta), f"{second}/content"),
            "analysis": (sinks.analysis_rows(done, "predictions", ["document_type"], F.col("confidence")), f"{second}/analysis"),
        }
    )
    done.unpersist()
    if any(outcome.values()):
        raise RuntimeError(f"a store failed: {outcome}")
    a, b = spark.read.parquet(f"{first}/documents"), spark.read.parquet(f"{second}/content")
    found_ = spark.read.parquet(f"{first}/entities").groupBy("document_id").agg(F.count("*").alias("n"))
    analysis = spark.read.parquet(f"{second}/analysis").select("document_id", "results")
    return a.join(b, "document_id").join(analysis, "document_id").join(found_, "document_id", "left").select(
        "document_id",
        "document_type",
        F.col("processing_metadata")["chars"].alias("meta_chars"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("entities"),
        F.get_json_object("results", "$.document_type").alias("analysed_type"),
    )


@query(
    "sink_results_json",
    f"""{DOCS} SELECT document_id, 'processed/' || document_id || '_results.json' AS results_path, document_type FROM ({typed('d')})""",
)
def sink_results_json(spark: SparkSession, base: str) -> DataFrame:
    path = scratch(spark, "results")
    sinks.write_results_json(scored(spark, base).select("document_id", "document_type", "confidence"), path)
    stored = spark.read.schema("document_id bigint, results_path string, results string").json(path)
    return stored.select("document_id", "results_path", F.get_json_object("results", "$.document_type").alias("document_type"))
