"""Learners, the model store and the projection, against numeric derivatives, forests and whole vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.operators import ml, network
from docweave.operators.modelstore import ModelStore
from docweave.plans import predict as plans


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(2)
    words = {"invoice": "payment due invoice total amount", "contract": "parties sign agreement term clause", "mail": "dear reader subject regards meeting"}
    common = "lorem ipsum dolor amet elit sed tempor labore magna aliqua".split()
    rows = []
    for i in range(240):
        label = ["invoice", "contract", "mail"][i % 3]
        own = [rng.choice(words[label].split()) for _ in range(rng.randint(1, 4))]
        rows.append((i, " ".join(own + [rng.choice(common) for _ in range(8)]), label))
    rows.append((999, "", "mail"))
    return ml.with_terms(spark.createDataFrame(rows, "document_id long, text string, label string")).cache()


def test_gradient_is_the_numeric_one():
    rng = np.random.default_rng(1)
    _, gradient = network.mathematics()
    weights = [rng.normal(size=(6, 4)), rng.normal(size=4), rng.normal(size=(4, 3)), rng.normal(size=3)]
    block = (np.array([0, 2, 1, 1]), np.array([0, 2, 2, 5, 6]), np.array([0, 3, 1, 2, 5, 4]), rng.normal(size=6))
    _, n, slopes = gradient(weights, block)
    assert n == 4
    for w, slope in zip(weights, slopes):
        for at in np.ndindex(w.shape):
            before = w[at]
            w[at] = before + 1e-6
            high = gradient(weights, block)[0]
            w[at] = before - 1e-6
            low = gradient(weights, block)[0]
            w[at] = before
            assert math.isclose((high - low) / 2e-6, slope[at], rel_tol=1e-4, abs_tol=1e-6)


def test_network_learns_epoch_by_epoch(texts):
    model, history = network.train_network(texts, "document_id", epochs=6, batches=3, features=256)
    told = {(r.epoch, r.split, r.metric): r.value for r in history.collect()}
    assert len(told) == 6 * 4
    assert told[6, "train", "loss"] < told[1, "train", "loss"] and told[6, "validation", "accuracy"] >= 0.9
    out = ml.predict(model, texts.drop("label"), "document_id").join(texts, "document_id")
    assert out.where("predicted_class = label").count() >= 0.9 * out.count() == 0.9 * 241
    assert out.where(F.abs(F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9).count() == 0


def test_boosted_trees_beat_the_forest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 8))
    labels = (x @ rng.normal(size=(8, 5)) + 0.3 * rng.normal(size=(900, 5))).argmax(1)
    rows = [(i, v.tolist(), str(label)) for i, (v, label) in enumerate(zip(x, labels))]
    df = spark.createDataFrame(rows, "id long, features array<double>, label string").cache()
    fit, held = df.where("id % 18 < 12"), df.where("id % 18 >= 12")
    right = lambda model: ml.predict_trees(model, held, "id").join(held, "id").where("predicted_class = label").count() / held.count()
    boosted, forest = right(ml.boosted_model(fit, rounds=30)), right(ml.forest_model(fit, trees=30))
    assert boosted >= forest > 1 / 5


def test_models_by_type_and_version(spark, texts, tmp_path):
    store = ModelStore(spark, str(tmp_path / "models"))
    assert store.versions().count() == 0 and store.find("text") is None and store.load_all() == {}
    with pytest.raises(KeyError):
        store.load("text")
    old = ml.text_pipeline(features=16, iterations=1).fit(texts)
    new = ml.text_pipeline(features=256, iterations=10).fit(texts)
    net = network.train_network(texts, "document_id", epochs=1, batches=1, features=64)[0]
    assert [store.save("text", old, {"f1": 0.5}), store.save("text", new, {"f1": 0.9}), store.save("net", net)] == [1, 2, 1]
    with pytest.raises(TypeError):
        store.save("text", object())
    listed = {(r.type, r.version): (r.kind, r.metrics) for r in store.versions().collect()}
    assert listed == {("text", 1): ("pipeline", {"f1": 0.5}), ("text", 2): ("pipeline", {"f1": 0.9}), ("net", 1): ("network", {})}
    rows = lambda model: sorted((r.document_id, r.predicted_class, round(r.confidence, 9)) for r in ml.predict(model, texts.drop("label"), "document_id").collect())
    for kind, version, model in (("text", None, new), ("text", 1, old), ("net", None, net)):
        assert rows(store.load(kind, version)) == rows(model)
    assert set(store.load_all()) == {"text", "net"}
    docs = texts.select("document_id", "text")
    typed = plans.predict_document_type(docs, "net", {"net": store.scorer("net", "document_id")})
    assert sorted((r.document_id, r.document_type) for r in typed.collect()) == [r[:2] for r in rows(net)]


def test_projection_keeps_angles_and_all_terms(spark):
    rng = random.Random(8)
    common = [f"c{k}" for k in range(30)]
    rows = [(i, " ".join([f"w{rng.randint(0, 3000)}" for _ in range(80)] + rng.choices(common, k=rng.randint(0, 60)))) for i in range(60)] + [(99, "")]
    df = spark.createDataFrame(rows, "document_id long, text string")
    got = {r.document_id: np.array(r.vector) for r in ml.projected(df, "document_id").collect()}
    from docweave.operators.tfidf import tfidf

    whole: dict[int, dict[str, float]] = {}
    for r in tfidf(df).collect():
        whole.setdefault(r.document_id, {})[r.term] = r.weight
    off = []
    for a in range(60):
        for b in range(a):
            true = sum(w * whole[b].get(t, 0.0) for t, w in whole[a].items())
            off.append(got[a] @ got[b] - true)
    assert max(map(abs, off)) < 6 / math.sqrt(ml.DIMENSIONS) and abs(np.mean(off)) < 0.01
    assert not got[99].any() and len(got) == 61 and all(len(v) == ml.DIMENSIONS for v in got.values())


def test_memory_of_a_step_is_bounded():
    """A block of 1.5 million words, one row of them very long: as the plain formula, in a small part of its memory."""
    import tracemalloc

    rng = np.random.default_rng(5)
    sizes = np.array([0, 300_000, 0, *[1200] * 1000, 0, 5])
    places = rng.integers(0, 64, sizes.sum()).astype(np.int32)
    values = rng.random(len(places))
    weights = [rng.normal(size=(64, 16)) / 50, rng.normal(size=16), rng.normal(size=(16, 2)), rng.normal(size=2)]
    block = (rng.integers(0, 2, len(sizes)), np.r_[0, np.cumsum(sizes)], places, values)
    forward, gradient = network.mathematics()
    tracemalloc.start()
    _, hidden, _, _ = forward(weights, block)
    _, _, slopes = gradient(weights, block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    rows = np.repeat(np.arange(len(sizes)), sizes)
    plain = np.tile(weights[1], (len(sizes), 1))
    np.add.at(plain, rows, values[:, None] * weights[0][places])
    assert np.allclose(hidden, plain)
    assert np.isfinite(slopes[0]).all()
    assert peak < 60e6, peak
