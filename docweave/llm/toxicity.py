"""Toxicity by maximum-scoring segments: token log-odds, all significant passages, extreme-value calibration.

A token is a run of ASCII letters and digits and of bytes beyond ASCII, A-Z lower-cased. Its log-odds
come from hierarchical Dirichlet (two classes: Beta) posteriors: a token's share of toxic documents is
drawn towards that of its longer and shorter beginnings, and the shortest one's towards the base rate,
so unseen tokens of a known family still score. A linear-time scan per text finds every maximal-scoring
segment. The scores of clean texts follow an extreme-value law in the text's length; its two parameters
are estimated, and the calibrated tail of the best passage and the number of significant passages give
the score.

Inputs with null or empty texts get the score of a text without tokens. Label, language, source and id
are never inputs of a score. Labels that are null are not learned from. Without any usable label, or
with one class only, every score is the (smoothed) base rate, and less than 0.5: nothing is called toxic.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm import words as W
from docweave.llm.store import alone, drop, keep

LEVELS = (3, 4, 5, 6, 7, 8, 10)  # beginnings, in bytes; the whole token follows
BITS = 20  # the log-odds table has 2**BITS slots whatever the input's size
DRIFT = 1.2  # taken off every token's log-odds, so that neutral words end a passage
PRIOR = 1.5  # pseudo-documents drawn from the next shorter beginning
SIGNIFICANT = 0.01  # expected passages of this score in a clean text of this length
MAX_LABELLED = 20_000  # labelled rows learned from; the bound of the sample

_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LEVEL = W.stream(29, len(LEVELS) + 1)


def _slots(texts: W.Texts) -> np.ndarray:
    """Table slots of each token: a row per level, the whole token last; -1 where a token is too short."""
    texts.words(_OUTSIDE)
    sums = texts.prefix(lower=True)
    out = np.full((len(LEVELS) + 1, len(texts.starts)), -1, np.int32)
    for row, size in enumerate((*LEVELS, None)):
        long = np.arange(len(texts.starts)) if size is None else np.flatnonzero(texts.ends - texts.starts > size)
        starts = texts.starts[long]
        h = texts.hashes(sums, starts, texts.ends[long] if size is None else starts + size)
        out[row, long] = W.mix(h ^ _LEVEL[row]) >> np.uint64(64 - BITS)
    return out


@dataclass
class Model:
    """``toxic``/``seen``: documents with a slot's token, by class; the rest is calibration."""

    toxic: np.ndarray
    seen: np.ndarray
    base: float
    rate: float = 0.0  # lambda of the extreme-value law
    log_k: float = 0.0
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def odds(self, slots: np.ndarray) -> np.ndarray:
        q = np.full(slots.shape[1], self.base)
        for row in slots:
            there = row >= 0
            at = row[there]
            q[there] = (self.toxic[at] + PRIOR * q[there]) / (self.seen[at] + PRIOR)
        return np.log(q / (1 - q)) - math.log(self.base / (1 - self.base)) - DRIFT

    def tail(self, scores: np.ndarray, tokens: int) -> np.ndarray:
        """Log of the passages of such a score that a clean text of this length holds by chance."""
        return self.log_k + math.log(max(tokens, 1)) - self.rate * scores

    def score(self, best: float, passages: int, tokens: int) -> float:
        a, b, c = self.weights
        x = max(0.0, -float(self.tail(np.array(best), tokens))) if best > 0 else 0.0
        z = a * math.log1p(x) + b * math.log1p(passages) + c
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def segments(odds: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), in one linear scan with a stack.

    Neighbouring tokens below zero are first taken together; only those above begin a segment.
    """
    at = np.flatnonzero(odds > 0)
    if not len(at):
        return []
    sums = np.concatenate([[0.0], np.cumsum(odds)])
    stack: list[tuple[int, int, float, float]] = []  # start, end, sum before it, sum at its end
    links: list[int] = []  # for each: the nearest one below whose left sum is smaller, or -1
    for i in at.tolist():
        new = (i, i + 1, float(sums[i]), float(sums[i + 1]))
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = links[j]
            if j < 0 or stack[j][3] >= new[3]:
                stack.append(new)
                links.append(j)
                break
            new = (stack[j][0], new[1], stack[j][2], new[3])
            del stack[j:], links[j:]
    return [(s, e, right - left) for s, e, left, right in stack]


def _scan(batches: Iterator[pa.RecordBatch], models: list[Model], pick: str | None) -> Iterator[tuple]:
    """Batch, row, tokens, model, segments and token odds of every text."""
    for batch in batches:
        which = batch.column(pick).to_pylist() if pick else None
        for texts in W.slices(batch.column("text")):
            slots = _slots(texts)
            odds = [m.odds(slots) for m in models]
            for i in range(texts.n):
                a, b = texts.bounds[i], texts.bounds[i + 1]
                k = which[texts.first + i] if which else 0
                row = odds[k][a:b]
                yield batch, texts, i, models[k], row, segments(row)


def _learned(spark, sample: DataFrame) -> tuple[list[Model], Model]:
    def counts(batches):
        seen = np.zeros((4, 1 << BITS), np.int32)  # row: 2 * fold + toxic
        for batch in batches:
            kind = np.array(batch.column("fold")) * 2 + np.array(batch.column("toxic"))
            for texts in W.slices(batch.column("text")):
                slots = _slots(texts)
                for i in range(texts.n):
                    got = np.unique(slots[:, texts.bounds[i] : texts.bounds[i + 1]])
                    seen[kind[texts.first + i], got[got >= 0]] += 1
        for row in range(4):
            at = np.flatnonzero(seen[row])
            columns = (np.full(len(at), row, np.int32), at.astype(np.int32), seen[row, at].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "slot", "n"])

    total = np.zeros((4, 1 << BITS), np.float32)
    rows = sample.mapInArrow(counts, "kind int, slot int, n long").groupBy("kind", "slot").agg(F.sum("n").alias("n"))
    got = rows.toArrow()  # 4 * 2**BITS rows at most
    total[np.array(got["kind"]), np.array(got["slot"])] = np.array(got["n"])
    docs = {(r.fold, r.toxic): r.n for r in sample.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    fold_n = [[docs.get((f, t), 0) for t in (0, 1)] for f in (0, 1)]

    def model(folds: list[int]) -> Model:
        toxic = sum(total[2 * f + 1] for f in folds)
        seen = sum(total[2 * f] for f in folds) + toxic
        yes, no = (sum(fold_n[f][t] for f in folds) for t in (1, 0))
        return Model(toxic, seen, (yes + 0.5) / (yes + no + 1.0))

    return [model([1]), model([0])], model([0, 1])  # a fold is calibrated with what the other one taught


def train(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from at most ``max_labelled`` rows of ``labels`` (doc_id, toxic), taken by a hash of their id.

    Copies of a text count once. The chosen ids are broadcast, their number being bounded; the other
    documents are not moved.
    """
    spark = documents.sparkSession
    labels = alone(labels, "doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    chosen = labels.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = keep(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled), "toxic-labels")
    texts = alone(documents, "doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = texts.withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    once = texts.groupBy("key").agg(F.max(F.struct("toxic", "text")).alias("x"))
    fold = F.pmod(F.shiftright("key", 7), F.lit(2)).cast("int").alias("fold")
    sample = keep(once.select("x.text", "x.toxic", fold), "toxic-sample")
    crossed, model = _learned(spark, sample)
    both = sample.groupBy("toxic").count().count() == 2
    if both:
        _calibrate(sample, crossed, model)
    else:
        rate = min(model.base, 0.49)
        model.weights = (0.0, 0.0, math.log(rate / (1 - rate)))
    drop(sample, chosen)
    return model


_EDGES = np.linspace(-8.0, 12.0, 401)


def _calibrate(sample: DataFrame, crossed: list[Model], model: Model) -> None:
    """Law of clean texts' best scores, then the weights, from each fold scored by the other one's model."""
    sent = sample.sparkSession.sparkContext.broadcast(crossed)

    def measure(batches):
        histogram = np.zeros(len(_EDGES) + 1, np.int64)
        rows = []

        for batch, texts, i, _, odds, found in _scan(batches, sent.value, "fold"):
            label = batch.column("toxic")[texts.first + i].as_py()
            if label == 0:
                histogram += np.bincount(np.searchsorted(_EDGES, odds), minlength=len(_EDGES) + 1)
            scores = sorted((s for *_, s in found), reverse=True)
            rows.append((label, len(odds), scores, None))
        rows.append((None, 0, None, histogram.tolist()))
        kinds = (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()))
        names = ("label", "tokens", "scores", "histogram")
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

    got = sample.mapInArrow(measure, "label int, tokens long, scores array<double>, histogram array<long>").collect()
    histogram = sum(np.array(r.histogram) for r in got if r.histogram is not None)
    rows = [r for r in got if r.histogram is None]  # bounded by max_labelled
    middles = np.concatenate([[_EDGES[0]], (_EDGES[1:] + _EDGES[:-1]) / 2, [_EDGES[-1]]])
    share = histogram / max(1, histogram.sum())

    def moment(rate: float) -> float:
        return float((share * np.exp(np.minimum(rate * middles, 700))).sum()) - 1

    low, high = 1e-3, 1.0
    while moment(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if moment(middle) < 0 else (low, middle)
    rate = (low + high) / 2
    clean = [rate * r.scores[0] - math.log(r.tokens) for r in rows if r.label == 0 and r.scores]
    log_k = float(np.mean(clean)) - 0.5772156649 if clean else 0.0
    for m in (model, *crossed):
        m.rate, m.log_k = rate, log_k
    x = np.array([[*_facts(model, r.scores, r.tokens), 1.0] for r in rows])
    y = np.array([float(r.label) for r in rows])
    w = np.zeros(3)
    for _ in range(50):  # Newton's method on the penalised logistic loss
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + np.array([0.1, 0.1, 0.0]) * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([0.1, 0.1, 1e-6])
        w = w - np.linalg.solve(hessian, gradient)
    model.weights = tuple(w.tolist())


def _facts(model: Model, scores: list[float], tokens: int) -> tuple[float, float]:
    if not scores:
        return 0.0, 0.0
    tail = model.tail(np.array(scores), tokens)
    return math.log1p(max(0.0, -float(tail[0]))), math.log1p(int((tail < math.log(SIGNIFICANT)).sum()))


_PASSAGES = pa.list_(
    pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("log_expected", pa.float64())])
)
_ADDED = {
    "score": ("double", pa.float64()),
    "n_passages": ("int", pa.int32()),
    "passages": ("array<struct<start:long,end:long,score:double,log_expected:double>>", _PASSAGES),
}


def _passages(texts: W.Texts, i: int, hits: list) -> list[dict]:
    """Places of the significant segments, in code points."""
    base, first = texts.offsets[i], texts.bounds[i]
    lead = texts.data[base : texts.offsets[i + 1]] & 0xC0 != 0x80
    chars = np.concatenate([[0], np.cumsum(lead)])
    return [
        {
            "start": int(chars[texts.starts[first + s] - base]),
            "end": int(chars[texts.ends[first + e - 1] - base]),
            "score": value,
            "log_expected": expected,
        }
        for (s, e, value), expected in hits
    ]


def annotate(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` with score (0 to 1), n_passages and passages: start and end (code points), score, and
    log of the number expected by chance. Columns of these names in the input are replaced."""
    kept = [c for c in documents.columns if c not in _ADDED]
    documents = documents.select(*[documents[c] for c in kept])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema] + [f"{k} {v[0]}" for k, v in _ADDED.items()])
    sent = documents.sparkSession.sparkContext.broadcast(model)
    limit = math.log(SIGNIFICANT)

    def run(batches):
        m = sent.value
        for batch in batches:
            scores = np.zeros(len(batch))
            passages: list[list] = [[]] * len(batch)
            for _, texts, i, _, odds, found in _scan(iter([batch]), [m], None):
                best, hits = 0.0, []
                if found:
                    values = np.array([s for *_, s in found])
                    tail = m.tail(values, len(odds))
                    best = float(values.max())
                    hits = [(f, t) for f, t in zip(found, tail.tolist()) if t < limit]
                if hits:
                    passages[texts.first + i] = _passages(texts, i, hits)
                scores[texts.first + i] = m.score(best, len(hits), len(odds))
            added = [pa.array(scores), pa.array([len(p) for p in passages], pa.int32()), pa.array(passages, _PASSAGES)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *_ADDED])

    return documents.mapInArrow(run, schema)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_passages and passages of every document."""
    return annotate(alone(documents, "doc_id", "text"), model).drop("text")
