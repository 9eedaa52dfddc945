"""Operators on vectors and pages, and the pipeline, against plain Python."""

import importlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from docweave.llm import htmltext, queries, store, topk, urls
from tests.llm.conftest import rows

# 2 URL filter --------------------------------------------------------------------------------------

RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def plain_url(url):
    if not url or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?", 1)[0].split("#", 1)[0]
    fit = [r for r in RULES if (h := r.split("/")[0]) and (host == h or host.endswith("." + h)) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fit, key=len, default=None)


URLS = [
    None, "", "no scheme", "://", "http://", "http://WWW.Example.COM/en/1?x=1#y", "https://m.example.com/en/", "http://example.com/en",
    "http://example.com", "http://notexample.com/en/", "ftp://x://y.net/es/", "http://a.net/es/b//c", "http://net/fr/", "http://b.org/?a=1&b=2&c",
    "http://É.com/ä?", "http://" + "a" * 5000 + ".net/fr/" + "9" * 5000, "http://x.example.com/en/\nz", "http://b.org/?a=1&b=2&c",
]


def test_url_rules_and_trees(spark):
    store.ready(spark)
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(URLS)], "page_id long, url string, html string")
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule = plain_url(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (RULES[rule] if rule else ("block" if got[i].p_block >= 0.5 else "allow"))
    more = pages.selectExpr("*", "1 AS key", "2 AS host", "3 AS suffix", "4 AS label", "5 AS features", "6 AS n")
    assert rows(urls.judge(more).drop("p_block")) == rows(urls.judge(pages).drop("p_block"))
    assert urls.judge(pages.where("false")).count() == 0
    assert urls.judge(pages.where("page_id = 8")).first().verdict == "allow"  # nothing to learn from


def test_trees_learn_lexical_features(spark):
    rng = random.Random(3)
    made = []
    for i in range(400):
        bad = i % 2 == 0
        tail = "".join(rng.choice("0123456789") for _ in range(rng.randint(15, 30))) if bad else rng.choice(["about", "news/today", "team"])
        decided = i < 300
        made.append((i, f"http://h{rng.randint(0, 9)}.{'net' if decided else 'org'}/{'es' if bad else 'de'}/{tail}", bad))
    pages = spark.createDataFrame([m[:2] for m in made], "page_id long, url string")
    rules = (("block", "net/es/"), ("allow", "net/de/"))
    got = {r.page_id: r.verdict for r in urls.judge(pages, rules).collect()}
    assert np.mean([(got[i] == "block") == bad for i, _, bad in made[300:]]) >= 0.95


def test_trees_on_held_out_urls(spark):
    """Decided URLs of a fold that taught nothing; the suffix tells nothing here, the digits do."""
    rng = random.Random(9)
    made = []
    for i in range(300):
        bad = rng.random() < 0.5
        tail = "".join(rng.choice("0123456789") for _ in range(rng.randint(15, 30))) if bad else rng.choice(["about", "news/today", "team"])
        made.append((i, f"http://h{rng.randint(0, 9)}.net/{'es' if bad else 'de'}/{tail}{i}"))
    pages = spark.createDataFrame(made, "page_id long, url string")
    store.ready(spark)
    got = urls.judge(pages, (("block", "net/es/"), ("allow", "net/de/")), held=0).where("p_block IS NOT NULL").collect()
    assert 30 <= len(got) <= 100 and all(r.rule for r in got)
    assert np.mean([(r.p_block >= 0.5) == (r.verdict == "block") for r in got]) >= 0.95


def test_own_label_never_teaches_its_suffix(spark):
    """Statistics of a decided URL don't change with its own verdict."""
    made = [(i, f"http://h{i}.{'net' if i % 2 else 'com'}/{'es' if i % 3 else 'de'}/x{i}") for i in range(40)]
    pages = spark.createDataFrame(made, "page_id long, url string")
    store.ready(spark)
    rows = urls.features(pages, (("block", "net/es/"), ("allow", "net/de/"))).withColumn("fold", F.pmod(F.xxhash64("key", F.lit(11)), F.lit(urls.FOLDS)).cast("int"))
    blocked = F.coalesce(F.col("ruled.verdict") == "block", F.lit(False))
    told = {r.page_id: r for r in urls.with_statistics(rows, blocked, None)[0].select("page_id", "suffix", "fold", "ruled", "suffix_share", "suffix_blocked").collect()}
    bad = [r for r in told.values() if r.ruled and r.ruled.verdict == "block"]
    decided = [r for r in told.values() if r.ruled]
    prior = (len(bad) + 1) / (len(decided) + 2)
    for r in told.values():
        own = lambda some: [x for x in some if x.suffix == r.suffix and not (r.ruled and x.fold == r.fold)]  # noqa: B023, E731
        assert math.isclose(r.suffix_blocked, (len(own(bad)) + 5 * prior) / (len(own(decided)) + 5)) and r.suffix_share == 0.5


# 5 exact top-k -------------------------------------------------------------------------------------


def plain_top(vectors, k, is_query):
    usable = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in usable if is_query(i)}):
        a = min(v for i, v in usable if i == q)
        dot = lambda v: max(-topk.LIMIT, min(topk.LIMIT, sum(x * y for x, y in zip(a, v))))  # noqa: B023, E731
        scored = sorted((-dot(v), i) for i, v in usable if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return out


@pytest.mark.parametrize("n, blocks, scale", [(0, 4, 1.0), (3, 4, 1.0), (150, 16, 0.2), (150, 64, 1e6), (60, 16, 1e15)])
def test_top_k(spark, monkeypatch, n, blocks, scale):
    store.ready(spark)
    monkeypatch.setattr(topk, "QUERIES", blocks)
    monkeypatch.setattr(topk, "CANDIDATES", blocks)
    rng = np.random.default_rng(n)
    vectors = [(i, [float(x) for x in np.round(rng.normal(size=4), 1) * scale]) for i in range(n)]
    vectors += [(1000 + i, [scale, scale, 0.0, 0.0]) for i in range(40)] if n else []  # ties
    vectors += [(2000, None), (2001, []), (2002, [None, 1.0, 1.0, 1.0]), (2003, [float("nan"), 1.0, 1.0, 1.0]), (2004, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({"q": F.lit(1), "score": F.lit("x")})
    got = topk.top_k(df, F.col("vec_id") % 5 == 0, 7)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    want = plain_top(vectors, 7, lambda i: i % 5 == 0)
    assert sorted(map(tuple, got.collect())) == want


def test_top_k_of_unequal_and_repeated_vectors(spark):
    vectors = [(0, [1.0]), (1, [1.0, 5.0]), (2, [-1.0]), (2, [-1.0]), (5, [2.0, 1.0]), (5, [0.5, 3.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id").isin(0, 5), 3).orderBy("query_id", "rank").collect()]
    assert [g for g in got if g[0] == 0] == [(0, 1, 5, 64 * 128), (0, 2, 1, 64 * 64), (0, 3, 5, 64 * 32)]
    assert len(got) == 6


# 7 HTML --------------------------------------------------------------------------------------------

ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body class="page">
<nav><ul><li><a href="/x">menu</a></ul></nav><div class="cookie-notice">We use cookies</div><header>Site</header>
<article><h1>Head &amp; more</h1><p>One&nbsp;two
  three<p><b>Bold</b> text<br>after break<div class="ad">Buy</div><aside>side</aside><ul><li>first<li>second</ul>
<form><input value="x>y">Name</form><!-- <p>no</p> --><p>5 < 6 &lt; 7</p><div id="comments"><p>Nice post</p></div></article>
<footer>&copy; me</footer>"""


def test_article_text():
    want = "Head & more\nOne two three\nBold text\nafter break\nfirst\nsecond\n5 < 6 < 7"
    assert htmltext.main_text(ARTICLE) == want
    assert htmltext.main_text(ARTICLE.replace("article>", "main>")) == want


def test_pages_without_an_article():
    body = "".join(f"<p>Sentence {i} of a long story that goes on for quite a while here.</p>" for i in range(8))
    page = f'<div><a href="a">home</a> <a href="b">news</a></div><div>{body}</div><p></p><div><a href=c>imprint and other pages</a></div>'
    assert htmltext.main_text(page).count("\n") == 7 and "imprint" not in htmltext.main_text(page)


SENTENCE = "<p>Sentence {} of a long story that goes on for quite a while here, and then on for some more.</p>"
STORY = "".join(SENTENCE.format(i) for i in range(8))


def test_window_sums_decide_inside_an_article():
    """No boilerplate here has a telling name."""
    more = "".join(f'<div><div><a href="/{i}"><b><i><u><em>Other story number {i}</em></u></i></b></a></div></div>' for i in range(5))
    text = htmltext.main_text(f"<article><h1>Title</h1>{STORY}<div>{more}</div><div>Buy cheap now</div></article>")
    assert text.split("\n")[0] == "Title" and text.count("\n") == 8 and "Other" not in text and "Buy" not in text


def test_names_only_weigh_inside_an_article():
    block = "".join(SENTENCE.format(f"{i} of the part with a name, which is as high as all the others and even more so") for i in range(4))
    text = htmltext.main_text(f'<article><header><h1>Title</h1></header>{STORY}<div class="share-notice">{block}</div><div class="ad">Buy</div></article>')
    assert text.startswith("Title\nSentence 0") and text.count("\n") == 12 and "Buy" not in text


def test_short_closing_part_and_links_in_the_text_stay():
    links = "".join(f"<p><a href=/{i}>menu entry {i}</a></p>" for i in range(4))
    page = f"<div>{STORY}<p><a href=/x>A line that is a link</a></p>{SENTENCE.format(9)}</div>{links}<p>The writer lives in a small town by the sea.</p>"
    text = htmltext.main_text(page)
    assert "A line that is a link" in text and text.endswith("by the sea.") and "menu" not in text


@pytest.mark.parametrize("page", [None, "", "plain", "<", "<a", "<p title='x", "</p></div>", "<!--", "<script>never closed", "<div>" * 3000 + "deep", "<p>" * 20000, "a<b>c" * 5000, "<x y=\"" * 2000])
def test_broken_pages(page):
    assert isinstance(htmltext.main_text(page), str)


@given(st.text(alphabet="<>/ab!-\"'= &;p\n", max_size=80))
@settings(max_examples=300, deadline=None)
def test_any_page(page):
    text = htmltext.main_text(page)
    assert all(line == " ".join(line.split()) and line for line in text.split("\n")) or text == ""


def test_extract(spark):
    store.ready(spark)
    df = spark.createDataFrame([(1, "u", ARTICLE), (1, "u", ARTICLE), (2, None, None), (None, "v", "<article>x</article>")], "page_id long, url string, html string")
    got = rows(htmltext.extract(df.selectExpr("*", "1 AS text", "2 AS n_chars")))
    assert len(got) == 4 and all(g[3] == len(g[2]) for g in got) and got == rows(htmltext.extract(df))
    assert htmltext.extract(df.where("false")).count() == 0


# The pipeline and the contract ---------------------------------------------------------------------


def test_pipeline_on_odd_rows(docs, crowded, empty, tmp_path):
    spark = docs.sparkSession
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    counts = []
    for table in (docs, crowded, empty):
        table.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        counts.append(corpus_pipeline.run(spark, str(tmp_path)).count())
    assert counts[0] == counts[1] > 0 == counts[2]


def test_pipeline_on_the_given_table(spark):
    base = "/root/testdata/sf0.01"
    seen = store.table(store.ready(spark), base, "documents")
    toxic = {r.doc_id for r in store.table(spark, base, "labels").where("toxic = 1").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = store.keep(stage(spark, seen, base), "test-stage")
        assert after.columns == list(corpus_pipeline.COLUMNS) and 0 < after.count() <= seen.count()
        if name == "toxicity":
            left = {r.doc_id for r in after.collect()}
            assert len(toxic & left) <= len(toxic) / 2
        seen = after
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, base)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in seen.collect()}


def test_contract():
    names = contract.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_others_do_not_need_this_subpackage():
    import ast
    from pathlib import Path

    root = Path(importlib.import_module("docweave").__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                if isinstance(node, (ast.Import, ast.ImportFrom)):
                    name = getattr(node, "module", None) or " ".join(a.name for a in node.names)
                    assert "docweave.llm" not in name


def test_sorted_numbers_equal_numpy():
    """Orders, distinct numbers and their places, also where numbers differ in their low bits only."""
    import numpy as np

    from docweave.llm import words as W

    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 1000, 70_000):
        for top in (1, 5, 1 << 20, 1 << 50, (1 << 63) - 1):
            for kind in (np.int64, np.uint64):
                v = rng.integers(0, top, n, endpoint=True).astype(kind)
                if kind is np.uint64 and top > 1 << 60:
                    v = v * np.uint64(2) + np.uint64(1)
                if top > 1 << 40 and n:
                    v[rng.integers(0, n, n // 2)] = v[rng.integers(0, n, n // 2)]
                    v[rng.integers(0, n, n // 2)] ^= kind(3)
                assert (W.order(v) == np.argsort(v, kind="stable")).all()
                for got, want in zip(W.unique(v), np.unique(v, return_index=True, return_inverse=True), strict=True):
                    assert got.dtype == want.dtype and (got == want).all()
                assert (W.distinct(v) == np.unique(v)).all()
