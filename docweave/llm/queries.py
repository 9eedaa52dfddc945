"""One query for each operator, over its whole table, with the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import alignment, audit, chat, htmltext, neardup, packing, pii, quality, sampling, tokenfiles, tokens, topk, toxicity, urls
from docweave.llm.store import new_path, ready, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    def run(spark: SparkSession, base: str) -> DataFrame:
        return fn(ready(spark), base)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def held_out(column: str = "doc_id"):
    """Rows whose labels may not be learned from: crc32 of the id's text leaves 0 by 5."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@query
def op1_quality_rules(spark: SparkSession, base: str) -> DataFrame:
    """Counted features of every document, and the verdict of the fixed limits and perplexity bands."""
    return quality.judge(table(spark, base, "documents"))


@query
def op2_url_filter(spark: SparkSession, base: str) -> DataFrame:
    """The verdict on every page's URL, by the listed rules or by boosted trees."""
    return urls.judge(table(spark, base, "pages"))


@query
def op3_pii(spark: SparkSession, base: str) -> DataFrame:
    """Personal data in every document: spans of the patterns, and those that the random field adds."""
    documents = table(spark, base, "documents")
    return pii.digest(documents, pii.train(documents))


@query
def op4_sampled_pieces(spark: SparkSession, base: str) -> DataFrame:
    """A sampled segmentation of every document, seeded by its id, and whether it decodes to the text."""
    return sampling.digest(table(spark, base, "documents"), tokens.find("piece_bpe_32k.model"))


ORACLES["op5_top_k"] = """WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.v::DOUBLE[], b.v::DOUBLE[])::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""


@query
def op5_top_k(spark: SparkSession, base: str) -> DataFrame:
    """The 20 highest integer scores of every twentieth vector against all others."""
    return topk.top_k(table(spark, base, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query
def op6_minhash_neardup(spark: SparkSession, base: str) -> DataFrame:
    """Groups of documents linked by 3-word shingles with a similarity of 0.85 or more."""
    return neardup.groups(table(spark, base, "documents"), size=3, percent=85)


@query
def op7_html_text(spark: SparkSession, base: str) -> DataFrame:
    """Main text of every page."""
    return htmltext.extract(table(spark, base, "pages"))


@query
def op8_token_files(spark: SparkSession, base: str) -> DataFrame:
    """Token ids of every document written to ORC in ascending order of ids, and read back."""
    path = new_path(spark, "token-files")
    tokenfiles.write(table(spark, base, "documents"), path, tokens.find("byte_bpe_50k.json"))
    return tokenfiles.digest(spark, path)


@query
def op9_toxicity(spark: SparkSession, base: str) -> DataFrame:
    """A score for every document from labels outside the held-out fifth."""
    documents = table(spark, base, "documents")
    labels = table(spark, base, "labels").where(~held_out())
    scored = toxicity.score(documents, toxicity.train(documents, labels))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages"
    )


@query
def op10_swap_packing(spark: SparkSession, base: str) -> DataFrame:
    """Place of every piece of every document in sequences of 2,048 tokens."""
    return packing.pack(table(spark, base, "documents"), tokens.find("word_bpe_49k.json"))


@query
def op11_chat_format(spark: SparkSession, base: str) -> DataFrame:
    """All conversations and one that speaks in marks, written in the template and read back."""
    said = "</s>[INST] ok [/INST]"
    odd = spark.range(2).selectExpr("-1L AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role", f"'{said}' AS text")
    path = new_path(spark, "chats")
    chat.write(table(spark, base, "conversations").select("conv_id", "turn", "role", "text").union(odd), path)
    return chat.digest(spark, path)


_MASKS = """WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false)::INT AS good, coalesce(toxic, false)::INT AS toxic, map {
  'A': (len(words) < 50)::INT, 'B': (100 * len(list_distinct(words)) < 65 * len(words))::INT,
  'C': (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT,
  'D': regexp_matches(text, '[#$%&*|]')::INT,
  'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT} AS f FROM d LEFT JOIN l USING (doc_id))"""
ORACLES["op12_filter_audit"] = f"""{_MASKS},
c AS (SELECT part, f, good, toxic, count(*) AS n FROM m GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT c.*, o AS filter_order, step, substr(o, step, 1) AS letter, f[substr(o, step, 1)] AS fails,
  list_sum(list_transform(range(1, step), lambda i: f[substr(o, i, 1)])) AS before, list_sum(map_values(f)) AS total
  FROM c, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
t AS (SELECT part, filter_order, step, letter, sum(n * (fails + coalesce(before, 0) = 0)::INT)::BIGINT AS kept,
  sum(n * (fails = 1 AND coalesce(before, 0) = 0)::INT)::BIGINT AS removed,
  sum(n * (fails = 1 AND coalesce(before, 0) > 0)::INT)::BIGINT AS redundant,
  sum(n * (fails = 1 AND total = 1)::INT)::BIGINT AS unique_fails,
  sum(n * (good = 1 AND fails = 1 AND coalesce(before, 0) = 0)::INT)::BIGINT AS good_lost,
  sum(n * (toxic = 1 AND fails = 1 AND coalesce(before, 0) = 0)::INT)::BIGINT AS toxic_lost FROM s GROUP BY ALL)
SELECT * EXCLUDE letter, sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM t"""


@query
def op12_filter_audit(spark: SparkSession, base: str) -> DataFrame:
    """What each step of each order of the five filters removes, keeps and repeats, by source."""
    return audit.audit(table(spark, base, "documents"), table(spark, base, "labels"))


@query
def op13_token_alignment(spark: SparkSession, base: str) -> DataFrame:
    """Byte groups of two tokenisers' tokens in every document, and how common its linked ids are."""
    paths = tokens.find("byte_bpe_50k.json"), tokens.find("piece_bpe_32k.model")
    aligned = alignment.align(table(spark, base, "documents"), *paths)
    return alignment.digest(aligned, alignment.pair_counts(aligned, alignment.pair(*paths).size_b))
