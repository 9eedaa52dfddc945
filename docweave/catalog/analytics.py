"""Document types, sentiment, TF-IDF, summaries, similarity, key phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.catalog.registry import array, literal, query, with_tables
from docweave.catalog.textprep import SENTENCES, TERMS, TOKENS, TRIMMED, documents
from docweave.functions import classify
from docweave.functions import text as prep
from docweave.operators import similar, tfidf
from docweave.sources import derived
from docweave.sources.tables import load

TYPED = with_tables(texts=derived.TYPED)


def score_sql(words: list[str]) -> str:
    hits = " + ".join(f"contains(lower(text), {literal(w)})::INTEGER" for w in words)
    return f"({hits}) / {len(words)}::DOUBLE"


SCORES = ", ".join(f"{score_sql(w)} AS s_{n}" for n, w in classify.KEYWORDS.items())
BEST = "greatest(" + ", ".join(f"s_{n}" for n in classify.KEYWORDS) + ")"
CHOICE = "CASE " + " ".join(f"WHEN s_{n} = {BEST} THEN '{n}'" for n in classify.KEYWORDS) + " END"


def typed(source: str = "texts") -> str:
    """Rows with ``document_type`` and ``type_confidence`` by keywords."""
    return f"SELECT *, {CHOICE} AS document_type, {BEST} AS type_confidence FROM (SELECT *, {SCORES} FROM {source})"


POS = f"len(list_filter({TOKENS}, lambda t: list_contains({array(classify.POSITIVE)}, t)))"
NEG = f"len(list_filter({TOKENS}, lambda t: list_contains({array(classify.NEGATIVE)}, t)))"


def felt(source: str = "texts") -> str:
    """Rows with ``label`` and ``score`` by the lexicon."""
    return f"""SELECT *, CASE WHEN p + n = 0 THEN 'UNKNOWN' WHEN p >= n THEN 'POSITIVE' ELSE 'NEGATIVE' END AS label,
CASE WHEN p + n = 0 THEN 0.0::DOUBLE ELSE greatest(p, n) / (p + n)::DOUBLE END AS score
FROM (SELECT *, {POS} AS p, {NEG} AS n FROM {source})"""


def _typed(spark: SparkSession, base: str) -> DataFrame:
    return derived.texts(spark, base, derived.TYPED).select(
        "document_id", classify.document_type(F.col("text")).alias("t")
    )


@query(
    "classify_doc_type",
    f"{TYPED} SELECT document_id, document_type, type_confidence AS confidence, s_email, s_letter FROM ({typed()})",
)
def classify_doc_type(spark: SparkSession, base: str) -> DataFrame:
    return _typed(spark, base).select(
        "document_id",
        "t.document_type",
        "t.confidence",
        F.col("t.scores")["email"].alias("s_email"),
        F.col("t.scores")["letter"].alias("s_letter"),
    )


@query(
    "agg_keyword_score",
    f"{TYPED} SELECT document_id, " + ", ".join(f"s_{n} AS {n}" for n in classify.KEYWORDS) + f" FROM ({typed()})",
)
def agg_keyword_score(spark: SparkSession, base: str) -> DataFrame:
    return (
        derived.texts(spark, base, derived.TYPED)
        .select("document_id", classify.keyword_scores(F.col("text")).alias("s"))
        .select("document_id", "s.*")
    )


@query(
    "argmax_doc_type",
    f"{TYPED} SELECT kind, document_type, count(*) AS n FROM ({typed()}) GROUP BY ALL",
)
def argmax_doc_type(spark: SparkSession, base: str) -> DataFrame:
    best = classify.document_type(F.col("text"))["document_type"]
    return (
        derived.texts(spark, base, derived.TYPED)
        .groupBy("kind", best.alias("document_type"))
        .agg(F.count("*").alias("n"))
    )


OWN = {"greeting": ["dear", "hello"], "money": ["$", "total", "invoice"]}


@query(
    "keyword_registry",
    f"{TYPED} SELECT document_id, CASE WHEN g >= m THEN 'greeting' ELSE 'money' END AS document_type, greatest(g, m) AS confidence "
    f"FROM (SELECT document_id, {score_sql(OWN['greeting'])} AS g, {score_sql(OWN['money'])} AS m FROM texts)",
)
def keyword_registry(spark: SparkSession, base: str) -> DataFrame:
    own = classify.document_type(F.col("text"), OWN)
    return (
        derived.texts(spark, base, derived.TYPED)
        .select("document_id", own.alias("t"))
        .select("document_id", "t.document_type", "t.confidence")
    )


@query(
    "label_decode",
    "SELECT vec_id, label, CASE label " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(classify.SERVICE_TYPES))
    + " ELSE 'unknown' END AS predicted_type, "
    + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {n}_score" for i, n in enumerate(classify.SERVICE_TYPES))
    + " FROM embeddings",
)
def label_decode(spark: SparkSession, base: str) -> DataFrame:
    """The class of a number, and the score of every class by its name."""
    scores = classify.score_map(F.transform("embedding", lambda x: x.cast("double")), classify.SERVICE_TYPES)
    return load(spark, base, "embeddings").select(
        "vec_id",
        "label",
        classify.decode_label(F.col("label"), classify.SERVICE_TYPES).alias("predicted_type"),
        *[scores[n].alias(f"{n}_score") for n in classify.SERVICE_TYPES],
    )


@query("sentiment", f"{TYPED} SELECT document_id, label, score FROM ({felt()})")
def sentiment(spark: SparkSession, base: str) -> DataFrame:
    return (
        derived.texts(spark, base, derived.TYPED)
        .select("document_id", classify.sentiment(F.col("text")).alias("s"))
        .select("document_id", "s.*")
    )


@query(
    "sentiment_3way",
    f"""{TYPED} SELECT document_id, p / (p + n + 1)::DOUBLE AS positive, 1 / (p + n + 1)::DOUBLE AS neutral,
n / (p + n + 1)::DOUBLE AS negative, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' WHEN p >= 1 THEN 'mixed' ELSE 'neutral' END AS sentiment
FROM ({felt()})""",
)
def sentiment_3way(spark: SparkSession, base: str) -> DataFrame:
    return (
        derived.texts(spark, base, derived.TYPED)
        .select("document_id", classify.sentiment_3way(F.col("text")).alias("s"))
        .select("document_id", "s.*")
    )


# --- TF-IDF -----------------------------------------------------------------------------------


def weights_sql(items: str = TERMS) -> str:
    return f"""tf AS (SELECT document_id, term, count(*) AS tf FROM (
  SELECT doc_id AS document_id, unnest({items}) AS term FROM documents) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT document_id, term, tf, df, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)::DOUBLE) + 1) AS weight
  FROM tf JOIN dfs USING (term))"""


@query(
    "agg_tfidf",
    f"""WITH {weights_sql()} SELECT document_id, term, tf, df,
round(weight / sqrt(sum(weight * weight) OVER (PARTITION BY document_id)), 9) AS weight FROM w""",
)
def agg_tfidf(spark: SparkSession, base: str) -> DataFrame:
    return tfidf.tfidf(documents(spark, base)).select(
        "document_id", "term", "tf", "df", F.round("weight", 9).alias("weight")
    )


BIGRAMS = f"""list_concat({TERMS}, list_transform(range(1, len({TERMS})), lambda i: {TERMS}[i] || ' ' || {TERMS}[i + 1]))"""


@query(
    "key_phrases",
    f"""WITH ts AS (SELECT doc_id, {TERMS} AS ts FROM documents),
grams AS (SELECT doc_id AS document_id, unnest(ts) AS term FROM ts UNION ALL
  SELECT doc_id, ts[i] || ' ' || ts[i + 1] FROM (SELECT doc_id, ts, unnest(range(1, len(ts))) AS i FROM ts)),
tf AS (SELECT document_id, term, count(*) AS tf FROM grams GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT document_id, term, round(tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)::DOUBLE) + 1), 9) AS score FROM tf JOIN dfs USING (term))
SELECT document_id, rank::INTEGER AS rank, term AS phrase, score FROM (
SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, term) AS rank FROM w) WHERE rank <= 5""",
)
def key_phrases(spark: SparkSession, base: str) -> DataFrame:
    return tfidf.key_phrases(documents(spark, base))


def summary_sql(source: str, keys: str, size: int = 3) -> str:
    """CTEs ending in ``summaries(keys, summary, error)`` for ``source(keys, text)``."""
    sent_terms = TERMS.replace("lower(text)", "lower(sentence)")
    return f"""parts AS (SELECT {keys}, text, {SENTENCES} AS ss FROM {source}),
sents AS (SELECT {keys}, len(ss) AS n, i, ss[i] AS sentence FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM parts WHERE len(ss) > {size})),
toks AS (SELECT {keys}, n, i, unnest({sent_terms}) AS term FROM sents),
stf AS (SELECT {keys}, n, i, term, count(*) AS tf FROM toks GROUP BY ALL),
sdf AS (SELECT {keys}, term, count(*) AS df FROM stf GROUP BY ALL),
sw AS (SELECT {keys}, i, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM stf JOIN sdf USING ({keys}, term)),
sscore AS (SELECT {keys}, i, round(sum(w) / sqrt(sum(w * w)), 9) AS score FROM sw GROUP BY ALL),
ranked AS (SELECT {keys}, i, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY {keys} ORDER BY coalesce(score, 0) DESC, i DESC) AS r
  FROM sents LEFT JOIN sscore USING ({keys}, i)),
tops AS (SELECT {keys}, list_sort(list(i)) AS top, max(score) AS best FROM ranked WHERE r <= {size} GROUP BY {keys}),
summaries AS (SELECT {keys}, CASE WHEN best IS NULL THEN text WHEN best > 0 THEN array_to_string(list_transform(top, lambda k: ss[k]), ' ') END AS summary,
  CASE WHEN best <= 0 THEN 'empty vocabulary' END AS error FROM parts LEFT JOIN tops USING ({keys}))"""


@query(
    "extractive_summary",
    f"WITH d AS (SELECT doc_id AS document_id, text FROM documents), {summary_sql('d', 'document_id')} SELECT * FROM summaries",
)
def extractive_summary(spark: SparkSession, base: str) -> DataFrame:
    return tfidf.extractive_summary(documents(spark, base))


@query(
    "win_topk_sentences",
    f"""WITH d AS (SELECT doc_id AS document_id, text FROM documents), {summary_sql('d', 'document_id')}
SELECT document_id, summary AS best_sentence FROM summaries""",
)
def win_topk_sentences(spark: SparkSession, base: str) -> DataFrame:
    """The three best sentences of every document, in the order they stand in."""
    top = tfidf.extractive_summary(documents(spark, base))
    return top.select("document_id", F.col("summary").alias("best_sentence"))


@query(
    "chunked_summary",
    f"""WITH d AS (SELECT document_id, chunk, text FROM (SELECT doc_id AS document_id, i AS chunk, length(text) <= 1024 AS whole, substr(text, i * 1024 + 1, 1024) AS text FROM (
SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 1024.0) AS BIGINT))) AS i FROM documents)) WHERE whole OR length({TRIMMED}) >= 50),
{summary_sql('d', 'document_id, chunk')}
SELECT document_id, coalesce(string_agg(summary, ' ' ORDER BY chunk), '') AS summary, count(*) AS chunks FROM summaries GROUP BY document_id""",
)
def chunked_summary(spark: SparkSession, base: str) -> DataFrame:
    return tfidf.chunked_summary(documents(spark, base))


SIDE = {s: TERMS.replace("lower(text)", f"lower({s})") for s in ("a_text", "b_text")}


@query(
    "pair_similarity",
    f"""WITH p AS (SELECT a.conv_id, a.turn, a.text AS a_text, b.text AS b_text FROM conversations a
  JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
t AS (SELECT conv_id, turn, unnest({SIDE['a_text']}) AS term, 1 AS a, 0 AS b FROM p
  UNION ALL SELECT conv_id, turn, unnest({SIDE['b_text']}), 0, 1 FROM p),
c AS (SELECT conv_id, turn, term, sum(a) AS a, sum(b) AS b FROM t GROUP BY ALL),
w AS (SELECT conv_id, turn, a::DOUBLE AS a, b::DOUBLE AS b, CASE WHEN a > 0 AND b > 0 THEN 1.0 ELSE ln(1.5) + 1 END AS f FROM c),
s AS (SELECT conv_id, turn, sum(a * b) AS d, sum((a * f) * (a * f)) AS aa, sum((b * f) * (b * f)) AS bb FROM w GROUP BY ALL)
SELECT conv_id, turn, round(CASE WHEN aa > 0 AND bb > 0 THEN d / (sqrt(aa) * sqrt(bb)) ELSE 0 END, 9) AS similarity
FROM p LEFT JOIN s USING (conv_id, turn)""",
)
def pair_similarity(spark: SparkSession, base: str) -> DataFrame:
    """Every turn of a conversation compared with the next one."""
    turns = load(spark, base, "conversations").select("conv_id", "turn", F.col("text").alias("a_text"))
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a_text").alias("b_text"))
    pairs = turns.join(following, ["conv_id", "turn"])
    out = tfidf.pair_similarity(pairs, ["conv_id", "turn"], "a_text", "b_text")
    return out.withColumn("similarity", F.round("similarity", 9))


RUNS = """CASE WHEN len(ts) = 0 THEN [] WHEN len(ts) < 5 THEN [array_to_string(ts, ' ')]
ELSE list_transform(range(1, len(ts) - 3), lambda i: array_to_string(ts[i : i + 4], ' ')) END"""


@query(
    "near_duplicate_pairs",
    f"""WITH RECURSIVE d AS (SELECT doc_id AS document_id, {TERMS} AS ts FROM documents),
s AS (SELECT document_id, list_sort(list_distinct({RUNS})) AS runs FROM d),
c AS (SELECT runs, min(document_id) AS class_id FROM s WHERE len(runs) > 0 GROUP BY runs),
x AS (SELECT class_id, len(runs) AS n, unnest(runs) AS run FROM c),
p AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS hits, any_value(a.n) + any_value(b.n) - count(*) AS total
  FROM x a JOIN x b ON a.run = b.run AND a.class_id <> b.class_id GROUP BY 1, 2),
r(node, seen) AS (SELECT class_id, class_id FROM c UNION SELECT node, p.b FROM r JOIN p ON seen = p.a WHERE 100 * hits >= 80 * total),
g AS (SELECT node, min(seen) AS representative FROM r GROUP BY node)
SELECT document_id, coalesce(class_id, document_id) AS class_id, coalesce(representative, document_id) AS representative,
  CASE WHEN representative = class_id THEN 1.0 WHEN class_id IS NOT NULL THEN round(coalesce(hits / total, 0), 9) END::DOUBLE AS similarity
FROM s LEFT JOIN c USING (runs) LEFT JOIN g ON node = class_id LEFT JOIN p ON p.a = class_id AND p.b = representative""",
)
def near_duplicate_pairs(spark: SparkSession, base: str) -> DataFrame:
    """Every document with its class of equal sets, its group's representative, and how similar it is to that."""
    docs = load(spark, base, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return similar.near_duplicates(docs).withColumn("similarity", F.round("similarity", 9))
