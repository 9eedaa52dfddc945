"""Spark ML: text classifiers, ensemble, trees, model choice, clustering, evaluation."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import (
    IDF,
    HashingTF,
    StringIndexer,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.classify import best_class
from docweave.functions.regex import let
from docweave.functions.text import preview, terms
from docweave.operators import tfidf
from docweave.operators.network import NetworkModel
from docweave.sources.stored import stored

SEED = 42
VALIDATION_SHARE = 0.2


def with_terms(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumn("words", terms(F.col(text_col)))


def split(df: DataFrame, key: str, share: float = VALIDATION_SHARE) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows by a hash of the key: the same on every run."""
    held = F.pmod(F.xxhash64(key), F.lit(1000)) < int(share * 1000)
    return df.where(~held), df.where(held)


def text_pipeline(features: int = 1 << 14, iterations: int = 20) -> Pipeline:
    """First learner: hashed TF-IDF and multinomial logistic regression; needs ``words, label``."""
    return Pipeline(
        stages=[
            StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc"),
            HashingTF(inputCol="words", outputCol="tf", numFeatures=features),
            IDF(inputCol="tf", outputCol="features"),
            LogisticRegression(
                labelCol="label_index", featuresCol="features", maxIter=iterations, regParam=0.01,
                family="multinomial",
            ),
        ]
    )


def labels_of(model: PipelineModel | NetworkModel) -> list[str]:
    return list(model.labels if isinstance(model, NetworkModel) else model.stages[0].labels)



def train(df: DataFrame, key: str, pipeline: Pipeline) -> tuple[PipelineModel, dict[str, float]]:
    """Fit on the training rows and score the held-out ones."""
    fit_rows, held = split(df, key)
    model = pipeline.fit(fit_rows)
    scored = model.transform(held)
    metric = MulticlassClassificationEvaluator(labelCol="label_index")
    names = ["accuracy", "weightedPrecision", "weightedRecall", "f1"]
    return model, {n: metric.setMetricName(n).evaluate(scored) for n in names}


def history(model: PipelineModel) -> list[float]:
    """Loss after every iteration of the first learner."""
    return list(model.stages[-1].summary.objectiveHistory)


def predict(model: PipelineModel | NetworkModel, df: DataFrame, key: str) -> DataFrame:
    """``(key, predicted_class, confidence, probabilities ARRAY, all_probabilities MAP)``."""
    labels = labels_of(model)
    names = F.array(*[F.lit(x) for x in labels])
    if isinstance(model, NetworkModel):
        return decode(model.predict(df, key), names)
    scored = model.transform(df.withColumn("label", F.lit(labels[0]))).select(
        key, vector_to_array("probability").alias("probabilities")
    )
    return decode(scored, names)


def decode(scored: DataFrame, names: Column) -> DataFrame:
    return scored.select(
        "*",
        F.get(names, best_class(F.col("probabilities"))).alias("predicted_class"),
        F.array_max("probabilities").alias("confidence"),
        F.map_from_arrays(names, F.col("probabilities")).alias("all_probabilities"),
    )


def ensemble(
    first: DataFrame, second: DataFrame, key: str, labels: list[str], weights: tuple[float, float] = (0.5, 0.5)
) -> DataFrame:
    """Weighted mean of two models' probabilities, matched by key and by class name.

    One of the two may be missing. A class that a model doesn't know has probability 0 there.
    """
    names = F.array(*[F.lit(x) for x in labels])
    by_name = lambda c: F.transform(names, lambda n: F.coalesce(F.col(c)[n], F.lit(0.0)))
    a = first.select(key, F.col("all_probabilities").alias("_a"))
    b = second.select(key, F.col("all_probabilities").alias("_b"))
    mixed = F.zip_with(by_name("_a"), by_name("_b"), lambda x, y: x * weights[0] + y * weights[1])
    one = F.when(F.col("_b").isNull(), by_name("_a")).when(F.col("_a").isNull(), by_name("_b")).otherwise(mixed)
    both = a.join(b, key, "full").select(key, one.alias("probabilities"))
    return decode(both, names)


def align(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Both models' predictions side by side, NULL where one has none."""
    a = first.select(key, F.struct("predicted_class", "confidence").alias("first_prediction"))
    b = second.select(key, F.struct("predicted_class", "confidence").alias("second_prediction"))
    return a.join(b, key, "full").withColumn("ensemble_method", F.lit("weighted_average"))


def _dense(df: DataFrame) -> DataFrame:
    return df.withColumn("vector", array_to_vector(F.col("features").cast("array<double>")))


def forest_model(df: DataFrame, trees: int = 100, depth: int = 6) -> PipelineModel:
    """A forest on dense vectors ``(features ARRAY, label)``, to measure the boosted trees by."""
    indexer = StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc")
    forest = RandomForestClassifier(labelCol="label_index", featuresCol="vector", numTrees=trees, maxDepth=depth, seed=SEED)
    return Pipeline(stages=[indexer, forest]).fit(_dense(df))


def boosted_model(df: DataFrame, rounds: int = 100, depth: int = 3, rate: float = 0.2, sample: float = 0.8, parallel: int = 8) -> PipelineModel:
    """Gradient-boosted trees for any number of classes on ``(features ARRAY, label)``.

    Spark's boosting tells two classes apart, so each class has trees of its own against the rest;
    ``parallel`` classes are trained at a time.
    """
    indexer = StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc")
    one = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=sample, featureSubsetStrategy="onethird", seed=SEED)
    every = OneVsRest(classifier=one, labelCol="label_index", featuresCol="vector", parallelism=parallel)
    return Pipeline(stages=[indexer, every]).fit(_dense(df))


def predict_trees(model: PipelineModel, df: DataFrame, key: str) -> DataFrame:
    """Predictions of either kind of trees, as ``predict`` gives them.

    A class's trees give half its log-odds; the classes' probabilities are scaled to one.
    """
    labels = labels_of(model)
    scored = model.transform(_dense(df))
    if "probability" in scored.columns:
        shares = vector_to_array("probability")
    else:
        odds = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
        shares = let(odds, lambda p: let(F.aggregate(p, F.lit(0.0), lambda a, x: a + x), lambda s: F.transform(p, lambda x: x / s)))
    return decode(scored.select(key, shares.alias("probabilities")), F.array(*[F.lit(x) for x in labels]))


def choose_model(df: DataFrame, grid: Mapping[str, list] | None = None, folds: int = 3) -> PipelineModel:
    """Model choice by cross validation over feature count and regularisation."""
    grid = dict(grid or {"features": [1 << 12, 1 << 14], "reg": [0.01, 0.1]})
    pipeline = text_pipeline()
    _, tf, _, lr = pipeline.getStages()
    params = (
        ParamGridBuilder()
        .addGrid(tf.numFeatures, grid["features"])
        .addGrid(lr.regParam, grid["reg"])
        .build()
    )
    search = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=params,
        evaluator=MulticlassClassificationEvaluator(labelCol="label_index", metricName="f1"),
        numFolds=folds,
        seed=SEED,
    )
    return search.fit(df).bestModel


def confusion_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class precision, recall, F1 and support from the confusion counts; plus the accuracy.

    Only the (class, class) counts are combined, never the rows.
    """
    cells = df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count("*").alias("n")
    )
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    by_class = cells.select(
        F.inline(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("guessed"), hit.cast("bigint").alias("tp")),
                F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("guessed"), F.lit(0).cast("bigint").alias("tp")),
            )
        )
    ).groupBy("class").agg(
        F.sum("actual").alias("support"), F.sum("guessed").alias("guessed"), F.sum("tp").alias("tp")
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    precision, recall = ratio(F.col("tp"), F.col("guessed")), ratio(F.col("tp"), F.col("support"))
    accuracy = cells.select(F.sum(hit) / F.sum("n")).scalar()
    return by_class.select(
        "class",
        "support",
        precision.alias("precision"),
        recall.alias("recall"),
        ratio(2 * precision * recall, precision + recall).alias("f1"),
        accuracy.alias("accuracy"),
    )


DIMENSIONS = 512  # of a projected document
SIGNS = 4  # places that a term adds to


def projected(df: DataFrame, key: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """``(key, vector)``: unit TF-IDF vectors of all terms, projected to ``dimensions`` numbers.

    Every term adds its weight to ``SIGNS`` places with signs, all told by its hash. There is no vocabulary,
    so no term is left out, and the expected dot product of two documents is that of their whole vectors,
    with a deviation of about one by the root of ``dimensions``. Document frequencies are counted and joined
    by Spark, on the terms' 64-bit hashes. Documents without terms get the zero vector.
    """
    hashed = F.transform(terms(F.col("text")), lambda t: F.xxhash64(t))
    weighted = tfidf.weights(df.select(key, "text"), key, hashed)
    lists = weighted.groupBy(key).agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))
    kind = df.schema[key].dataType.simpleString()
    signs = SIGNS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = batch.slice(at, 1000)
                names = rows.column("terms").flatten().to_numpy().astype(np.uint64)
                weights = rows.column("weights").flatten().to_numpy()
                n = rows.num_rows
                owner = np.repeat(np.arange(n), pc.list_value_length(rows.column("terms")).to_numpy())
                weights = weights / np.sqrt(np.bincount(owner, weights * weights, n))[owner]
                vectors = np.zeros(n * dimensions)
                for k in range(signs):
                    x = (names ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
                    x ^= x >> np.uint64(32)
                    x *= np.uint64(0xD6E8FEB86659FD93)
                    x ^= x >> np.uint64(32)
                    sign = np.where(x >> np.uint64(63), 1.0, -1.0)
                    place = owner * dimensions + ((x & np.uint64(0x7FFFFFFF)) % np.uint64(dimensions)).astype(np.int64)
                    vectors += np.bincount(place, sign * weights / signs**0.5, n * dimensions)
                bounds = pa.array(np.arange(n + 1) * dimensions, pa.int32())
                yield pa.RecordBatch.from_arrays([rows.column(key), pa.ListArray.from_arrays(bounds, pa.array(vectors))], [key, "vector"])

    some = lists.mapInArrow(run, f"{key} {kind}, vector array<double>")
    nothing = F.array_repeat(F.lit(0.0), dimensions)
    return df.select(key).join(some, key, "left").select(key, F.coalesce("vector", nothing).alias("vector"))


def cluster(df: DataFrame, key: str, clusters: int = 3, dimensions: int = DIMENSIONS) -> DataFrame:
    """``(key, cluster)`` by k-means on projected TF-IDF vectors; at most one cluster per distinct vector."""
    made = stored(projected(df, key, dimensions), "projected")
    available = made.select(F.xxhash64("vector").alias("v")).distinct().limit(clusters).count()
    if available < 2:
        return df.select(key, F.lit(0).alias("cluster"))
    made = made.select(key, array_to_vector("vector").alias("features"))
    model = KMeans(k=min(clusters, available), seed=SEED, maxIter=20).fit(made)
    return model.transform(made).select(key, F.col("prediction").alias("cluster"))


def cluster_members(df: DataFrame, assigned: DataFrame, key: str, size: int = 200) -> DataFrame:
    """Members of every cluster with a preview, one row each: a cluster may be a third of the corpus."""
    shown = df.select(key, preview(F.col("text"), size).alias("preview"))
    return assigned.join(shown, key).select("cluster", key, "preview")
