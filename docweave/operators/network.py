"""The second learner: a small feed-forward network, trained epoch by epoch on all executors.

Rows become blocks of sparse features that stay where they are. A step sends the weights out, takes the
gradient of one batch of rows from every block, adds them up in a tree and moves the weights by Adam on the
driver. The batch is a share of the rows, so the number of steps of an epoch does not grow with the data,
and what reaches the driver is one gradient, as large as the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.feature import StringIndexer
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

HISTORY = "epoch int, split string, metric string, value double"
BLOCK = 2048  # rows of a block
ENTRIES = 1 << 18  # words after which a block is closed, whatever its rows
# Adam's usual decay rates, and what keeps it from dividing by zero.
DECAY, DECAY_SQUARE, TINY = 0.9, 0.999, 1e-8


def mathematics():
    """``(forward, gradient)`` of one block; made here, so that workers need not import this package.

    A block is ``(labels, starts, places, values)``: row i has the features ``starts[i]`` to ``starts[i + 1]``.
    Entries are gone through in slices, as each of them meets a row of weights; a long text takes several.
    """
    slice_ = 1 << 16

    def slices(n):
        return [slice(a, a + slice_) for a in range(0, n, slice_)]

    def forward(weights, block):
        first, bias, second, other = weights
        labels, starts, places, values = block
        rows = np.repeat(np.arange(len(labels), dtype=np.int32), np.diff(starts))
        hidden = np.tile(bias, (len(labels), 1))
        for part in slices(len(places)):
            own = rows[part]  # the entries of a row lie one after the other
            begins = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            hidden[own[begins]] += np.add.reduceat(values[part, None] * first[places[part]], begins)
        active = np.maximum(hidden, 0)
        scores = active @ second + other
        scores = np.exp(scores - scores.max(1, keepdims=True))
        return rows, hidden, active, scores / scores.sum(1, keepdims=True)

    def gradient(weights, block):
        """Sum of the losses and of their derivatives, and the number of rows."""
        first, _, second, _ = weights
        labels, _, places, values = block
        rows, hidden, active, shares = forward(weights, block)
        at = np.arange(len(labels))
        loss = -np.log(np.maximum(shares[at, labels], 1e-300)).sum()
        wrong = shares.copy()
        wrong[at, labels] -= 1
        back = (wrong @ second.T) * (hidden > 0)
        by_feature = np.zeros_like(first)
        for part in slices(len(places)):
            each = values[part, None] * back[rows[part]]
            by_feature += np.stack([np.bincount(places[part], column, len(first)) for column in each.T], 1)
        return loss, len(labels), [by_feature, back.sum(0), active.T @ wrong, wrong.sum(0)]

    return forward, gradient


def places_of(words: Column, features: int) -> Column:
    """Feature of every word, by its hash."""
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(features)).cast("int"))


def _blocks(size: int, weight: np.ndarray, most: int = ENTRIES):
    """Rows ``(held, batch, label_index, places)`` to blocks ``(held, batch, block)``."""

    def run(rows: Iterator[Row]):
        waiting: dict[tuple[bool, int], list[tuple[int, np.ndarray]]] = {}
        entries: dict[tuple[bool, int], int] = {}

        def made(key):
            some = waiting.pop(key)
            entries.pop(key)
            places = np.concatenate([p for _, p in some])
            starts = np.cumsum([0] + [len(p) for _, p in some])
            return (*key, (np.array([label for label, _ in some]), starts, places, weight[places]))

        for row in rows:
            key = (row["held"], row["batch"])
            places = np.array(row["places"], np.int32)
            waiting.setdefault(key, []).append((int(row["label_index"]), places))
            entries[key] = entries.get(key, 0) + len(places)
            if len(waiting[key]) >= size or entries[key] >= most:
                yield made(key)
        for key in list(waiting):
            yield made(key)

    return run


@dataclass
class NetworkModel:
    """Trained weights, the inverse document frequency of every feature, and the names of the classes."""

    idf: np.ndarray
    labels: list[str]
    weights: list[np.ndarray]

    def predict(self, df: DataFrame, key: str) -> DataFrame:
        """``(key, probabilities)`` of ``df(key, words)``."""
        forward, _ = mathematics()
        sent = df.sparkSession.sparkContext.broadcast((self.idf, self.weights))
        rows = df.select(key, places_of(F.coalesce("words", F.array().cast("array<string>")), len(self.idf)).alias("places"))
        kind = df.schema[key].dataType.simpleString()
        most = ENTRIES

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            idf, weights = sent.value
            for frame in frames:
                sizes = np.array([len(p) for p in frame["places"]], np.int64)
                ends = np.cumsum(sizes)
                shares = []
                at = 0
                while at < len(sizes):  # as many rows as hold ``most`` words, one at least
                    to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
                    places = np.concatenate([*frame["places"][at:to], np.zeros(0, np.int32)]).astype(np.int32)
                    block = (np.zeros(to - at, np.int64), np.r_[0, np.cumsum(sizes[at:to])], places, idf[places])
                    shares += list(forward(weights, block)[3])
                    at = to
                yield pd.DataFrame({key: frame[key], "probabilities": shares})

        return rows.mapInPandas(run, f"{key} {kind}, probabilities array<double>")

    def save(self, spark: SparkSession, path: str) -> None:
        arrays = [self.idf, *self.weights]
        rows = [(i, list(w.shape), w.ravel().tolist(), self.labels) for i, w in enumerate(arrays)]
        spark.createDataFrame(rows, "i int, shape array<int>, values array<double>, labels array<string>").coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> NetworkModel:
        rows = spark.read.parquet(path).orderBy("i").collect()
        idf, *weights = [np.array(r["values"]).reshape(r["shape"]) for r in rows]
        return NetworkModel(idf, list(rows[0]["labels"]), weights)


def train_network(
    df: DataFrame,
    key: str,
    held_share: float = 0.2,
    epochs: int = 10,
    batches: int = 4,
    rate: float = 0.01,
    hidden: int = 16,
    features: int = 1 << 14,
    seed: int = 42,
) -> tuple[NetworkModel, DataFrame]:
    """Train on ``df(key, words, label)``; the model, and loss and accuracy of both splits after each epoch.

    A hash of the key says which rows are held out and to which batch of an epoch the others belong.
    """
    spark = df.sparkSession
    held = F.pmod(F.xxhash64(key), F.lit(1000)) < int(held_share * 1000)
    batch = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(batches)).cast("int")
    marked = df.select(key, places_of(F.col("words"), features).alias("places"), "label", held.alias("held"), batch.alias("batch"))
    names = StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc").fit(marked)
    taught = marked.where(~F.col("held"))
    # At most one row a feature.
    per = taught.select(F.explode(F.array_distinct("places")).alias("place")).groupBy("place").agg(F.count("*").alias("n")).collect()
    idf = np.full(features, float(taught.count() + 1))
    idf[[r["place"] for r in per]] /= np.array([r["n"] + 1 for r in per])
    idf = np.log(idf)
    rows = names.transform(marked).select("held", "batch", "label_index", "places")
    if rows.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        rows = rows.repartition(spark.sparkContext.defaultParallelism)
    blocks = rows.rdd.mapPartitions(_blocks(BLOCK, idf)).persist(StorageLevel.MEMORY_AND_DISK)
    forward, gradient = mathematics()
    rng = np.random.default_rng(seed)
    classes = len(names.labels)
    weights = [rng.normal(0, (2 / 64) ** 0.5, (features, hidden)), np.zeros(hidden), rng.normal(0, (2 / hidden) ** 0.5, (hidden, classes)), np.zeros(classes)]
    mean, square, steps, told = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0, []

    def added(a, b):
        return (a[0] + b[0], a[1] + b[1], [x + y for x, y in zip(a[2], b[2])]) if a and b else a or b

    def scored(a, b):
        for split, (loss, right, n) in b.items():
            x = a.get(split, (0.0, 0, 0))
            a[split] = (x[0] + loss, x[1] + right, x[2] + n)
        return a

    try:
        for epoch in range(1, epochs + 1):
            for batch in rng.permutation(batches).tolist():
                sent = spark.sparkContext.broadcast(weights)

                def step(total, b, batch=batch, sent=sent):
                    if b[0] or b[1] != batch:
                        return total
                    loss, n, slopes = gradient(sent.value, b[2])
                    return added(total, (loss, n, [x.astype(np.float32) for x in slopes]))

                total = blocks.treeAggregate(None, step, added)
                sent.unpersist()
                if total is None:
                    continue
                steps += 1
                for i, g in enumerate(total[2]):
                    g = g / total[1]
                    mean[i] = DECAY * mean[i] + (1 - DECAY) * g
                    square[i] = DECAY_SQUARE * square[i] + (1 - DECAY_SQUARE) * g * g
                    move = mean[i] / (1 - DECAY**steps) / (np.sqrt(square[i] / (1 - DECAY_SQUARE**steps)) + TINY)
                    weights[i] = weights[i] - rate * move
            sent = spark.sparkContext.broadcast(weights)

            def score(block, sent=sent):
                shares = forward(sent.value, block[2])[3]
                labels = block[2][0]
                loss = -np.log(np.maximum(shares[np.arange(len(labels)), labels], 1e-300)).sum()
                return {"validation" if block[0] else "train": (float(loss), int((shares.argmax(1) == labels).sum()), len(labels))}

            sums = blocks.map(score).treeAggregate({}, scored, scored)
            sent.unpersist()
            for split, (loss, right, n) in sorted(sums.items()):
                told += [(epoch, split, "loss", loss / n), (epoch, split, "accuracy", right / n)]
    finally:
        blocks.unpersist()
    return NetworkModel(idf, list(names.labels), weights), spark.createDataFrame(told, HISTORY)
