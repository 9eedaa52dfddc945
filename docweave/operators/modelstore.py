"""Trained models by type and version: saved, listed, loaded by name.

A model is written to a folder of its own first; the row that makes it a version is written last, so a
version either is whole or does not exist. The newest version of a type is found when it is asked for.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import ml
from docweave.operators.network import NetworkModel
from docweave.sources.stored import folders

VERSIONS = "type string, version int, kind string, path string, metrics map<string,double>"


def _save(spark: SparkSession, model, path: str) -> str:
    if isinstance(model, NetworkModel):
        model.save(spark, path)
        return "network"
    if not isinstance(model, PipelineModel):
        raise TypeError(f"no way to store a {type(model).__name__}")
    model.write().save(path)
    return "pipeline"


_LOAD: Mapping[str, Callable] = {"network": NetworkModel.load, "pipeline": lambda spark, path: PipelineModel.load(path)}


class ModelStore:
    """Models below ``path``. One writer per type at a time; any number of readers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> DataFrame:
        """``VERSIONS`` of all that is stored."""
        if not folders(self.spark, f"{self.path}/versions"):
            return self.spark.createDataFrame([], VERSIONS)
        return self.spark.read.schema(VERSIONS).json(f"{self.path}/versions/*")

    def save(self, kind: str, model, metrics: Mapping[str, float] | None = None) -> int:
        """Store the next version of a type; its number."""
        taken = [int(f.rsplit("-", 1)[1]) for f in folders(self.spark, f"{self.path}/versions") if f.rsplit("-", 1)[0] == kind]
        version = max(taken, default=0) + 1
        path = f"{self.path}/models/{kind}-{version}-{uuid.uuid4().hex}"
        row = {"type": kind, "version": version, "kind": _save(self.spark, model, path), "path": path, "metrics": dict(metrics or {})}
        line = self.spark.createDataFrame([(json.dumps(row),)], "value string").coalesce(1)
        line.write.text(f"{self.path}/versions/{kind}-{version}")
        return version

    def find(self, kind: str, version: int | None = None):
        """Row of a version, the newest one if none is named; None if there is none."""
        rows = self.versions().where(F.col("type") == kind)
        rows = rows if version is None else rows.where(F.col("version") == version)
        return rows.orderBy(F.desc("version")).first()

    def load(self, kind: str, version: int | None = None):
        row = self.find(kind, version)
        if row is None:
            raise KeyError(f"Model type {kind} not found")
        return _LOAD[row["kind"]](self.spark, row["path"])

    def load_all(self) -> dict[str, object]:
        """The newest model of every type."""
        newest = self.versions().groupBy("type").agg(F.max("version").alias("version")).collect()
        return {r["type"]: self.load(r["type"], r["version"]) for r in newest}

    def save_all(self, models: Mapping[str, object]) -> dict[str, int]:
        return {kind: self.save(kind, model) for kind, model in models.items()}

    def scorer(self, kind: str, key: str, version: int | None = None) -> Callable[[DataFrame], DataFrame]:
        """What ``predict_document_type`` takes: adds ``document_type`` and ``confidence`` to texts."""
        model = self.load(kind, version)

        def score(df: DataFrame) -> DataFrame:
            guessed = ml.predict(model, ml.with_terms(df).select(key, "words"), key)
            return df.join(guessed.select(key, F.col("predicted_class").alias("document_type"), "confidence"), key)

        return score
