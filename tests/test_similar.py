"""Set-similarity join against all pairs."""

import random

import pytest

from docweave.functions.text import STOP_WORDS
from docweave.operators import graph, similar


def plain_runs(text, size=5):
    import re

    words = [w for w in re.findall(r"\w{2,}", (text or "").lower()) if w not in STOP_WORDS]
    return frozenset(" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def plain(rows, percent=80):
    sets = [plain_runs(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    out = []
    for i, (key, _) in enumerate(rows):
        if not sets[i]:
            out.append((key, key, key, None))
            continue
        same = min(k for (k, _), s in zip(rows, sets) if s == sets[i])
        head, of = min(((k, n) for n, (k, _) in enumerate(rows) if group[n] == group[i]), key=lambda x: x[0])
        out.append((key, same, head, round(len(sets[i] & sets[of]) / len(sets[i] | sets[of]), 9)))
    return sorted(out, key=repr)


def made(seed, texts=60):
    rng = random.Random(seed)
    word = lambda: "w%02d" % rng.randint(0, 40)
    out = [None, "", "the of", "one", "one", "one two three four", "one two three four five", " One  TWO three four!"]
    common = [word() for _ in range(30)]
    while len(out) < texts:
        kind = rng.random()
        words = list(common) if kind < 0.5 else [word() for _ in range(rng.randint(1, 60))]
        if kind < 0.3:
            for _ in range(rng.randint(0, 3)):
                words[rng.choice([0, len(words) - 1, rng.randrange(len(words))])] = word()
        elif kind < 0.5:
            words = words * rng.randint(1, 2) + [word() for _ in range(rng.randint(0, 9))]
        out.append(" ".join(words))
    return [(i * 7 % 1009, t) for i, t in enumerate(out)]


def got(spark, rows, **more):
    df = similar.near_duplicates(spark.createDataFrame(rows, "document_id long, text string"), **more)
    return sorted(((r[0], r[1], r[2], None if r[3] is None else round(r[3], 9)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = made(seed)
    assert got(spark, rows) == plain(rows)


def test_no_round_and_chains(spark, monkeypatch):
    """The last comparison alone finds everything, also chains whose ends are unlike."""
    monkeypatch.setattr(similar, "ROUNDS", 0)
    words = [f"u{i}" for i in range(200)]
    chain = [(i, " ".join(words[6 * i : 6 * i + 80])) for i in range(20)]
    rows = made(3, 40) + [(5000 + i, t) for i, t in chain]
    assert got(spark, rows) == plain(rows)
    assert any(r[3] is not None and r[3] < 0.8 for r in plain(rows))


def test_nothing_similar_and_nothing_at_all(spark):
    rows = [(i, " ".join(f"x{i}y{k}" for k in range(9))) for i in range(12)]
    assert got(spark, rows) == plain(rows) == [(i, i, i, 1.0) for i in sorted(range(12), key=lambda i: repr((i, i, i, 1.0)))]
    assert got(spark, []) == []


def test_connected(spark):
    rng = random.Random(5)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    found = {r.node: r.root for r in graph.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {n: n for link in links for n in link}
    for _ in parent:
        for a, b in links:
            low = min(parent[a], parent[b])
            parent[a] = parent[b] = low
    assert found == {n: p for n, p in parent.items() if any(n in link and link[0] != link[1] for link in links)}


def test_runs_are_shuffled_once_for_their_lists(spark, tmp_path):
    from docweave.operators import similar

    rows = [(bytes([i]), 2, [i, i + 1]) for i in range(4)]
    spark.createDataFrame(rows, "class binary, n int, runs array<bigint>").write.parquet(str(tmp_path / "known"))
    got = similar.lists(spark.read.parquet(str(tmp_path / "known")), 50)
    plan = got._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.split("\n") if "Exchange hashpartitioning(run" in x]
    assert len(dealt) == 1
    assert {(r.run, bytes(r["class"])) for r in got.collect()} >= {(1, b"\x00"), (1, b"\x01"), (2, b"\x01"), (2, b"\x02")}
