"""Trained models on the labelled tables."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.catalog.registry import query
from docweave.operators import ml
from docweave.operators.modelstore import ModelStore
from docweave.operators.network import NetworkModel, train_network
from docweave.plans import predict as plans
from docweave.session import scratch
from docweave.sources import derived
from docweave.sources.stored import stored
from docweave.sources.tables import load

KEY = "document_id"


def labelled(spark: SparkSession, base: str) -> DataFrame:
    """Labelled documents with their terms, written once for all passes of training; the label is the quality."""
    docs = derived.source(spark, base, "documents").select(F.col("doc_id").alias(KEY), "text")
    labels = load(spark, base, "labels").select(
        F.col("doc_id").alias(KEY), F.when(F.col("quality") == 1, "good").otherwise("poor").alias("label")
    )
    return stored(ml.with_terms(docs.join(labels, KEY)).select(KEY, "words", "label"), "labelled")


def unlabelled(spark: SparkSession, base: str) -> DataFrame:
    docs = derived.source(spark, base, "documents").select(F.col("doc_id").alias(KEY), "text")
    return ml.with_terms(docs).select(KEY, "words")


def first_model(spark: SparkSession, base: str, rows: DataFrame | None = None) -> PipelineModel:
    return ml.text_pipeline().fit(ml.split(labelled(spark, base) if rows is None else rows, KEY)[0])


def second_model(spark: SparkSession, base: str, rows: DataFrame | None = None) -> NetworkModel:
    return train_network(labelled(spark, base) if rows is None else rows, KEY)[0]


def shown(df: DataFrame) -> DataFrame:
    return df.select(KEY, "predicted_class", F.round("confidence", 6).alias("confidence"))


@query("train_classifier")
def train_classifier(spark: SparkSession, base: str) -> DataFrame:
    """First learner; its predictions for the whole corpus."""
    return shown(ml.predict(first_model(spark, base), unlabelled(spark, base), KEY))


@query("train_classifier_nn")
def train_classifier_nn(spark: SparkSession, base: str) -> DataFrame:
    return shown(ml.predict(second_model(spark, base), unlabelled(spark, base), KEY))


@query("predict_classifier")
def predict_classifier(spark: SparkSession, base: str) -> DataFrame:
    out = ml.predict(first_model(spark, base), unlabelled(spark, base), KEY)
    return out.select(KEY, "predicted_class", "confidence", F.explode("all_probabilities").alias("class", "probability"))


@query("argmax_class")
def argmax_class(spark: SparkSession, base: str) -> DataFrame:
    """The most probable class of every document, beside the probabilities it was chosen from."""
    out = ml.predict(first_model(spark, base), unlabelled(spark, base), KEY)
    best = F.array_max(F.col("probabilities"))
    return out.select(KEY, "predicted_class", best.alias("probability"), F.col("all_probabilities.good").alias("good"), F.col("all_probabilities.poor").alias("poor"))


@query("agg_train_metrics")
def agg_train_metrics(spark: SparkSession, base: str) -> DataFrame:
    """Loss and accuracy of the network on both splits after every epoch; the first learner's loss and scores."""
    rows = labelled(spark, base)
    model, metrics = ml.train(rows, KEY, ml.text_pipeline())
    told = [("regression", i, "train", "loss", float(v)) for i, v in enumerate(ml.history(model))]
    told += [("regression", len(told) - 1, "validation", name, float(v)) for name, v in metrics.items()]
    first = spark.createDataFrame(told, "model string, epoch int, split string, metric string, value double")
    second = train_network(rows, KEY)[1].select(F.lit("network").alias("model"), "*")
    return first.unionByName(second)


@query("ensemble_predict")
def ensemble_predict(spark: SparkSession, base: str) -> DataFrame:
    taught = labelled(spark, base)
    first, second = first_model(spark, base, taught), second_model(spark, base, taught)
    rows = unlabelled(spark, base)
    both = ml.ensemble(
        ml.predict(first, rows, KEY), ml.predict(second, rows, KEY), KEY, ml.labels_of(first)
    )
    return shown(both)


@query("ensemble_align")
def ensemble_align(spark: SparkSession, base: str) -> DataFrame:
    """One model over all documents, the other over the labelled ones: each has one prediction or two."""
    taught = labelled(spark, base)
    first = ml.predict(first_model(spark, base, taught), unlabelled(spark, base), KEY)
    second = ml.predict(second_model(spark, base, taught), taught.drop("label"), KEY)
    return ml.align(first, second, KEY).select(
        KEY,
        F.col("first_prediction.predicted_class").alias("first_class"),
        F.col("second_prediction.predicted_class").alias("second_class"),
        "ensemble_method",
    )


@query(
    "agg_eval_metrics",
    """WITH p AS (SELECT quality AS label, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS prediction FROM labels JOIN documents USING (doc_id)),
c AS (SELECT unnest([0, 1])::INTEGER AS class),
m AS (SELECT class, count(*) FILTER (WHERE label = class) AS support, count(*) FILTER (WHERE prediction = class) AS guessed,
  count(*) FILTER (WHERE label = class AND prediction = class) AS tp, (SELECT avg((label = prediction)::INTEGER) FROM p) AS accuracy FROM c, p GROUP BY class),
r AS (SELECT *, CASE WHEN guessed > 0 THEN tp / guessed ELSE 0.0 END::DOUBLE AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0.0 END::DOUBLE AS recall FROM m)
SELECT class, support, precision, recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 9)::DOUBLE AS f1,
round(accuracy, 9) AS accuracy FROM r""",
)
def agg_eval_metrics(spark: SparkSession, base: str) -> DataFrame:
    """Quality guessed from the length alone, scored per class."""
    docs = load(spark, base, "documents").select("doc_id", (F.col("n_chars") > 500).cast("int").alias("prediction"))
    guessed = load(spark, base, "labels").join(docs, "doc_id")
    out = ml.confusion_metrics(guessed, "quality", "prediction")
    return out.withColumns({"f1": F.round("f1", 9), "accuracy": F.round("accuracy", 9)})


@query("tree_classifier")
def tree_classifier(spark: SparkSession, base: str) -> DataFrame:
    """Boosted trees for all labels of the vectors."""
    rows = load(spark, base, "embeddings").select("vec_id", F.col("embedding").alias("features"), F.col("label").cast("string").alias("label"))
    out = ml.predict_trees(ml.boosted_model(rows), rows, "vec_id")
    return out.select("vec_id", "predicted_class", F.round("confidence", 6).alias("confidence"))


@query("automl_text_train")
def automl_text_train(spark: SparkSession, base: str) -> DataFrame:
    """Best of several settings by cross validation, then applied to the corpus."""
    rows = labelled(spark, base).persist()
    try:
        model = ml.choose_model(rows)
    finally:
        rows.unpersist()
    return shown(ml.predict(model, unlabelled(spark, base), KEY))


@query("save_load_model")
def save_load_model(spark: SparkSession, base: str) -> DataFrame:
    """Two types, one in two versions, stored; the newest of each found by its type and applied."""
    store = ModelStore(spark, scratch(spark, "models"))
    taught = labelled(spark, base)
    store.save("text", ml.text_pipeline(features=1 << 10, iterations=5).fit(ml.split(taught, KEY)[0]))
    store.save_all({"text": first_model(spark, base, taught), "network": second_model(spark, base, taught)})
    docs = derived.source(spark, base, "documents").select(F.col("doc_id").alias(KEY), "text")
    out = []
    for kind in ("text", "network"):
        typed = plans.predict_document_type(docs, kind, {kind: store.scorer(kind, KEY)})
        version = F.lit(store.find(kind)["version"]).alias("version")
        out.append(typed.select(KEY, F.lit(kind).alias("model"), version, F.col("document_type").alias("predicted_class"), F.round("confidence", 6).alias("confidence")))
    return out[0].unionByName(out[1])


@query("jsonl_batch_transform")
def jsonl_batch_transform(spark: SparkSession, base: str) -> DataFrame:
    """Bulk scoring: JSON lines in, JSON lines out."""
    source, target = scratch(spark, "bulk-in"), scratch(spark, "bulk-out")
    derived.source(spark, base, "documents").select(F.col("doc_id").alias(KEY), "text").write.json(source)
    rows = ml.with_terms(spark.read.schema(f"{KEY} bigint, text string").json(source))
    shown(ml.predict(first_model(spark, base), rows, KEY)).write.json(target)
    return spark.read.schema(f"{KEY} bigint, predicted_class string, confidence double").json(target)


@query("s3_prefix_transform")
def s3_prefix_transform(spark: SparkSession, base: str) -> DataFrame:
    """Bulk scoring of everything below a prefix (several folders of JSON)."""
    prefix = scratch(spark, "prefix")
    docs = derived.source(spark, base, "documents").select(F.col("doc_id").alias(KEY), "text", "lang")
    docs.write.partitionBy("lang").json(prefix)
    rows = ml.with_terms(spark.read.schema(f"{KEY} bigint, text string, lang string").json(prefix))
    scored = ml.predict(first_model(spark, base), rows, KEY)
    return shown(scored)


@query("model_hook")
def model_hook(spark: SparkSession, base: str) -> DataFrame:
    """A user's model by name beside the keyword scorer."""
    model = first_model(spark, base)

    def scorer(df: DataFrame) -> DataFrame:
        guessed = ml.predict(model, ml.with_terms(df).select(KEY, "words"), KEY)
        return df.join(
            guessed.select(KEY, F.col("predicted_class").alias("document_type"), "confidence"), KEY
        )

    docs = derived.source(spark, base, "documents").select(F.col("doc_id").alias(KEY), "text")
    out = plans.predict_document_type(docs, "quality", {"quality": scorer})
    return out.select(KEY, "document_type", F.round("confidence", 6).alias("confidence"), "method")


@query("sentiment_model")
def sentiment_model(spark: SparkSession, base: str) -> DataFrame:
    """Sentiment from a model trained on the toxicity labels."""
    docs = derived.source(spark, base, "documents").select(F.col("doc_id").alias(KEY), "text")
    labels = load(spark, base, "labels").select(
        F.col("doc_id").alias(KEY), F.when(F.col("toxic") == 1, "NEGATIVE").otherwise("POSITIVE").alias("label")
    )
    rows = ml.with_terms(docs.join(labels, KEY)).select(KEY, "words", "label")
    model = ml.text_pipeline().fit(rows)
    out = ml.predict(model, unlabelled(spark, base), KEY)
    return out.select(KEY, F.col("predicted_class").alias("label"), F.round("confidence", 6).alias("score"))


def _clusters(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    docs = derived.source(spark, base, "documents").select(F.col("doc_id").alias(KEY), "text")
    return docs, ml.cluster(docs, KEY)


@query("cluster_documents")
def cluster_documents(spark: SparkSession, base: str) -> DataFrame:
    return _clusters(spark, base)[1]


@query("agg_cluster_members")
def agg_cluster_members(spark: SparkSession, base: str) -> DataFrame:
    return ml.cluster_members(*_clusters(spark, base), KEY)


@query("batch_process_nlp")
def batch_process_nlp(spark: SparkSession, base: str) -> DataFrame:
    """Language analysis of every document, with its cluster."""
    docs, clusters = _clusters(spark, base)
    return plans.process_documents(docs).join(clusters, KEY, "left").select(
        KEY, "original_length", "processed_tokens", "document_type.document_type", "sentiment.label", "summary", "cluster"
    )
