"""Preparation, types, TF-IDF and summaries against plain Python."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from docweave.functions import classify
from docweave.functions import files as fn
from docweave.functions import privacy
from docweave.functions import text as prep
from docweave.operators import tfidf

TEXTS = [
    None,
    "",
    "   ",
    "Café can't  cannot\t3 WORDS",
    "one. two! three?",
    "Alpha beta gamma. Beta delta. Epsilon zeta alpha alpha. Eta theta iota kappa. The and of.",
    "The. And of. Is was. Be been. Or if.",
    "Same words here. Same words here. Same words here. Same words here.",
    "\xa0ten chars!  ",
]


def df(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "document_id long, text string")


def clean(text):
    text = re.sub(r"[^a-zA-Z\s]", "", text or "").lower()
    return re.sub(r"\s+", " ", text).strip()


def words(text):
    return [w for w in re.findall(r"(?u)\b\w\w+\b", text.lower()) if w not in prep.STOP_WORDS]


def test_clean_and_gates(spark):
    rows = df(spark).orderBy("document_id").select(
        prep.clean_text(F.col("text")),
        prep.enough_for_nlp(F.col("text")),
        prep.enough_for_image(F.col("text")),
        prep.present(F.col("text")),
    ).collect()
    for text, row in zip(TEXTS, rows, strict=True):
        size = len((text or "").strip())
        assert tuple(row) == (clean(text), size >= 10, size > 10, bool(text))


def test_tokens(spark):
    row = spark.range(1).select(
        prep.tokenize(F.lit("i cannot wanna cannots")), prep.lemmatize(F.array(*map(F.lit, ["boxes", "cities", "men", "glass", "cats", "bus"])))
    ).first()
    assert row[0] == ["i", "can", "not", "wan", "na", "cannots"]
    assert row[1] == ["box", "city", "man", "glass", "cat", "bus"]


def test_chunks_previews_padding(spark):
    text = "x" * 2049
    row = spark.range(1).select(
        prep.chunks(F.lit(text)).alias("c"),
        prep.preview(F.lit(text), 100).alias("p"),
        prep.preview(F.lit("short"), 100).alias("s"),
        prep.pad_post(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint")), 4).alias("post"),
        prep.pad_pre(F.array(*[F.lit(i).cast("bigint") for i in range(6)]), 4).alias("pre"),
    ).first()
    assert [len(c) for c in row.c] == [1024, 1024, 1]
    assert row.p == "x" * 100 + "..." and row.s == "short"
    assert row.post == [1, 2, 0, 0] and row.pre == [2, 3, 4, 5]


def expected_summary(text, size=3):
    sents = [s for s in re.split(r"(?<=[.!?])\s+", text or "") if s]
    if len(sents) <= size:
        return text, None
    docs = [Counter(words(s)) for s in sents]
    freq = Counter(t for d in docs for t in d)
    if not freq:
        return None, "empty vocabulary"
    n = len(sents)
    scores = []
    for d in docs:
        w = {t: c * (math.log((1 + n) / (1 + freq[t])) + 1) for t, c in d.items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        scores.append(round(sum(w.values()) / norm, 9) if norm else 0.0)
    top = sorted(sorted(range(n), key=lambda i: (-scores[i], -i))[:size])
    return " ".join(sents[i] for i in top), None


def test_summary_equals_formula(spark):
    rows = tfidf.extractive_summary(df(spark)).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert (r.summary, r.error) == expected_summary(TEXTS[r.document_id])


def test_best_sentences_are_three(spark):
    from docweave.catalog import QUERIES
    from docweave.sources.tables import load

    from tests.conftest import DATA

    texts = {r.doc_id: r.text for r in load(spark, DATA, "documents").collect()}
    got = {r.document_id: r.best_sentence for r in QUERIES["win_topk_sentences"](spark, DATA).collect()}
    assert got == {k: expected_summary(t)[0] for k, t in texts.items()}
    assert any(len(re.findall(r"[.!?](?=\s|$)", got[k])) > 1 and got[k] != t for k, t in texts.items())


def test_summary_shuffles_the_texts_once(spark):
    plan = tfidf.extractive_summary(df(spark))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 2  # the same one on both join sides


def test_similarity(spark):
    pairs = spark.createDataFrame(
        [(1, "alpha beta beta", "alpha gamma"), (2, "same text twice", "same text twice"), (3, "the of", "alpha"), (4, "", "")],
        "id long, a string, b string",
    )
    got = {r.id: r.similarity for r in tfidf.pair_similarity(pairs, ["id"], "a", "b").collect()}
    u = math.log(1.5) + 1
    assert math.isclose(got[1], 1 / (math.hypot(1, 2 * u) * math.hypot(1, u)))
    assert math.isclose(got[2], 1.0) and got[3] == 0.0 and got[4] == 0.0


def test_similarity_keeps_the_most_frequent_terms(spark):
    pairs = spark.createDataFrame([(1, "aa aa bb bb cc", "aa bb dd")], "id long, a string, b string")
    got = tfidf.pair_similarity(pairs, ["id"], "a", "b", max_terms=2).first().similarity
    assert math.isclose(got, 4 / (math.sqrt(8) * math.sqrt(2)))


def test_tfidf_rows_have_length_one(spark):
    docs = df(spark).where("length(text) > 5")
    norms = tfidf.tfidf(docs).groupBy("document_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n"))
    assert all(math.isclose(r.n, 1.0) for r in norms.collect())


def test_document_types(spark):
    got = spark.createDataFrame(
        [("nothing",), ("Dear Jo, yours truly, best regards, Sincerely",), ("from: to: subject: dear",), ("terms and total",)], "text string"
    ).select(classify.document_type(F.col("text")).alias("t")).collect()
    assert [(r.t.document_type, r.t.confidence) for r in got] == [
        ("invoice", 0.0), ("letter", 1.0), ("email", 0.8), ("invoice", 0.2),
    ]
    assert set(got[0].t.scores) == set(classify.KEYWORDS)


def test_sentiment(spark):
    got = spark.createDataFrame([("good good bad",), ("nothing",), ("bad",)], "text string").select(
        classify.sentiment(F.col("text")).alias("s"), classify.sentiment_3way(F.col("text")).alias("w")
    ).collect()
    assert [(r.s.label, round(r.s.score, 6)) for r in got] == [("POSITIVE", 0.666667), ("UNKNOWN", 0.0), ("NEGATIVE", 1.0)]
    assert all(math.isclose(r.w.positive + r.w.neutral + r.w.negative, 1.0) for r in got)


def test_files(spark):
    got = spark.createDataFrame([("a/b.tar.GZ",), ("a.d/.bashrc",), ("x.PDF",), ("plain",)], "p string").select(
        fn.basename(F.col("p")), fn.extension(F.col("p")), fn.type_error(F.col("p"))
    ).collect()
    assert [tuple(r)[:2] for r in got] == [("b.tar.GZ", ".GZ"), (".bashrc", ""), ("x.PDF", ".PDF"), ("plain", "")]
    assert got[2][2] is None and got[0][2] == "Unsupported file type: .gz"


def test_protection(spark):
    key, other = F.lit("0123456789abcdef"), F.lit("fedcba9876543210")
    df_ = spark.createDataFrame([("secret",), ("",)], "v string")
    kept = df_.select("v", privacy.encrypt(F.col("v"), key).alias("t")).select(
        "v", privacy.decrypt(F.col("t"), key).alias("back"), privacy.decrypt(F.col("t"), other).alias("wrong")
    ).collect()
    assert all(r.v == r.back and r.wrong == "" for r in kept)
    shown = spark.range(1).select(privacy.redact(F.lit("ssn 123-45-6789 mail a@b.com call 555-123-4567"))).first()[0]
    assert shown == "ssn [SSN] mail [EMAIL] call [PHONE]"


def test_terms_counted_inside_the_row(spark):
    from collections import Counter

    from docweave.operators import tfidf

    lists = [(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["x"]), (1, ["b", "c"])]
    df = spark.createDataFrame(lists, "k long, ws array<string>")
    own = [Counter({r.term: r.tf for r in x.c or []}) for x in df.select(tfidf.counted(F.col("ws")).alias("c")).collect()]
    assert own == [Counter(ws or []) for _, ws in lists]
    # A key in several rows is one document, as the SQL has it.
    assert {(r.k, r.term): r.tf for r in tfidf.term_counts(df, "k", F.col("ws")).collect()} == {
        (1, "a"): 1, (1, "b"): 3, (1, "c"): 1, (4, "x"): 1
    }
    parts = ["Red blue red.", "", "the of", "blue green blue blue"]
    found = spark.createDataFrame([(parts,)], "ss array<string>").select(tfidf.sentence_terms(F.col("ss")).alias("t")).first().t
    assert sorted((r.sentence, r.tf or 0, r.df or 0) for r in found) == sorted(
        [(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0), (0, 2, 1), (0, 1, 2), (3, 3, 2), (3, 1, 1)]
    )


def test_summaries_hold_no_terms_in_shuffles(spark):
    """Terms are counted inside the rows: no window and no grouping over them."""
    from docweave.operators import tfidf

    df = spark.createDataFrame([(1, "One two. Three four. Five six. Seven eight.")], "document_id long, text string")
    plan = tfidf.extractive_summary(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "_term" not in plan


def test_corpus_terms_are_counted_once(spark, tmp_path):
    """Frequencies and weights read what was counted, they don't cut the texts again."""
    spark.createDataFrame([(1, "one two two"), (2, "two three"), (3, None)], "document_id int, text string").write.parquet(str(tmp_path / "t"))
    got = tfidf.tfidf(spark.read.parquet(str(tmp_path / "t")))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
    assert sorted((r.document_id, r.term, r.tf, r.df) for r in got.collect()) == [(1, "one", 1, 1), (1, "two", 2, 2), (2, "three", 1, 1), (2, "two", 1, 2)]


def test_language_analysis_cleans_a_text_once(spark):
    from docweave.plans.predict import process_documents

    df = spark.createDataFrame([(1, "Good children ran to the buses, cannot fail!"), (2, None)], "document_id int, text string")
    got = process_documents(df, include_summary=False)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("[a-zA-Z") == 1
    rows = {r.document_id: r for r in got.collect()}
    want = df.select("document_id", F.size(prep.preprocess(F.col("text"))).alias("n"), classify.sentiment(F.col("text")).alias("s")).collect()
    assert all(rows[r.document_id].processed_tokens == r.n and rows[r.document_id].sentiment == r.s for r in want)


def test_blanks_are_cleaned_one_by_one(spark):
    """Every kind of blank, alone and in runs, is one blank, without an expression that matches them all."""
    blanks = [c for c in map(chr, range(0x3001)) if c.isspace()]
    texts = ["".join(f"A{c}b{c}{c} 1{c}" for c in blanks), *[f"{c}It's  a{c}b-c{c}" for c in blanks], "", None, " \t "]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    column = prep.clean_text(F.col("t"))
    got = {r.i: r.c for r in made.select("i", column.alias("c")).collect()}
    plain = lambda t: re.sub(r"\s+", " ", "".join(c for c in t or "" if c.isspace() or c.isascii() and c.isalpha()).lower()).strip()
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    assert "translate(" in str(column)
