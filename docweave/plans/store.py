"""Runs of the eleven steps that leave tables behind: staged, committed by a manifest, safe to repeat.

A run goes through stages. What a stage has worked out lies in a folder of the run, so a run that was lost
goes on with the first stage that is not there. The last stage writes the tables, each to a folder of the
run, and then, as the last thing of all, the manifest: one row a document. Readers take only rows of runs
that have a manifest, and of several runs of a document the newest, so half a run is never seen, and a run
that is repeated changes nothing.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.files import results_path
from docweave.operators.entities import explode_entities
from docweave.plans import process
from docweave.sources import sinks
from docweave.sources.stored import folders, remove
from docweave.sources.tables import spread

Stage = tuple[str, Sequence[process.Step]]
STAGES: list[Stage] = [("intake", process.REGISTRY[:4]), ("analysis", process.REGISTRY[4:8]), ("storing", process.REGISTRY[8:])]
TABLES = ("documents", "entities", "analysis", "logs", "summary")


class RunStore:
    """Tables of processed documents below ``base``. One writer for a run's name at a time."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def committed(self) -> list[str]:
        """Names of the runs that are whole."""
        return [f.removeprefix("run=") for f in folders(self.spark, f"{self.base}/manifest")]

    def run(self, files: DataFrame, name: str, stages: Sequence[Stage] = STAGES) -> None:
        """Process ``files`` (see ``process``) as the run ``name``, unless it is there already."""
        if name in self.committed():
            return
        work = f"{self.base}/runs/{name}"
        df, done = process.start(files), folders(self.spark, work)
        for number, (stage, steps) in enumerate(stages):
            folder = f"{number}-{stage}"
            if folder not in done:
                began, clock = datetime.now(UTC), time.perf_counter()
                if number:  # what a scan of the stage before gives a task follows bytes, the work follows rows
                    df = spread(df, "document_id")
                for _, step in steps:
                    df = df.transform(step)
                df.write.mode("overwrite").parquet(f"{work}/{folder}-rows")
                took = [(number, stage, step, began, time.perf_counter() - clock) for step, _ in steps]
                times = self.spark.createDataFrame(took, "number int, stage string, step string, timestamp timestamp, duration double")
                times.coalesce(1).write.mode("overwrite").parquet(f"{work}/{folder}")
            df = self.spark.read.parquet(f"{work}/{folder}-rows")
        times = self.spark.read.parquet(*[f"{work}/{i}-{stage}" for i, (stage, _) in enumerate(stages)])
        processed = process.finish(df, [step for _, steps in stages for step, _ in steps])
        for table, rows in self._tables(processed, times).items():
            rows.write.mode("overwrite").parquet(f"{self.base}/tables/{table}/run={name}")
        stored = F.coalesce("database_storage.success", F.lit(False))
        manifest = processed.select("document_id", "success", stored.alias("stored"), F.current_timestamp().alias("committed_at"))
        manifest.write.mode("overwrite").parquet(f"{self.base}/manifest/run={name}")
        remove(self.spark, work)

    @staticmethod
    def _tables(processed: DataFrame, times: DataFrame) -> dict[str, DataFrame]:
        kept = processed.where("database_storage.success")
        now = F.current_timestamp()
        kind, sure = F.col("database_storage.document_type"), F.col("database_storage.confidence_score")
        body = F.col("ocr_processing.text")
        documents = kept.select(
            "document_id", "path", F.col("size").alias("file_size"), kind.alias("document_type"), sure.alias("confidence_score"), body.alias("extracted_text")
        )
        entities = explode_entities(kept.where("entity_extraction.success"), F.col("entity_extraction.patterns"))
        results = [c for c in ("file_validation", "text_analysis", "entity_extraction", "document_classification", "sentiment_analysis") if c in processed.columns]
        logs = processed.select("document_id", F.inline("processing_log"))
        # One row a step: small at every size.
        timed = logs.join(F.broadcast(times.select("step", "stage", "duration", "timestamp")), "step")
        return {
            "documents": sinks.document_rows(documents, now, ["document_id"]),
            "entities": sinks.entity_rows(entities.withColumnRenamed("entity_type", "type")),
            "analysis": sinks.analysis_rows(kept, "processing", results, sure).withColumn(
                "results_path", results_path(F.col("document_id").cast("string"))
            ),
            "logs": sinks.log_rows(timed, ["stage", "error"]),
            "summary": process.summarize(processed),
        }

    def read(self, table: str) -> DataFrame:
        """Rows of a table with their ``run``: of every document those of its newest whole run."""
        runs = self.committed()
        if not runs:
            raise FileNotFoundError(f"no run has been completed below {self.base}")
        read = lambda place: self.spark.read.option("basePath", place).parquet(*[f"{place}/run={r}" for r in runs])
        manifest = read(f"{self.base}/manifest").select("document_id", F.col("run").cast("string"), "committed_at")
        newest = manifest.groupBy("document_id").agg(F.max_by("run", F.struct("committed_at", "run")).alias("run"))
        rows = read(f"{self.base}/tables/{table}").withColumn("run", F.col("run").cast("string"))
        return rows.join(newest, ["document_id", "run"], "left_semi")

    def cleanup(self) -> list[str]:
        """Remove what runs without a manifest have left, except stages to go on with; the folders removed."""
        whole, gone = set(self.committed()), []
        for table in TABLES:
            place = f"{self.base}/tables/{table}"
            gone += [f"{place}/{f}" for f in folders(self.spark, place, whole_only=False) if f.removeprefix("run=") not in whole]
        gone += [f"{self.base}/runs/{f}" for f in folders(self.spark, f"{self.base}/runs", whole_only=False) if f in whole]
        for path in gone:
            remove(self.spark, path)
        return gone
