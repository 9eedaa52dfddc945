"""Cleaning, tokens, sentences, chunks, previews, vocabularies, protection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.catalog.extraction import re2
from docweave.catalog.registry import array, in_list, literal, query, with_tables
from docweave.functions import privacy
from docweave.functions import text as prep
from docweave.functions.entities import PATTERNS
from docweave.functions.regex import SPACE
from docweave.operators import tfidf
from docweave.operators.skew import with_position
from docweave.sources import derived
from docweave.sources.tables import load

CLEAN = r"trim(regexp_replace(lower(regexp_replace(coalesce(text, ''), '[^a-zA-Z\s]', '', 'g')), '\s+', ' ', 'g'))"


def split_words(clean: str) -> str:
    joined = clean
    for word, parts in prep.CONTRACTIONS.items():
        joined = f"regexp_replace({joined}, '\\b{word}\\b', '{parts}', 'g')"
    return f"list_filter(string_split({joined}, ' '), lambda t: t <> '')"


TOKENS = split_words(CLEAN)
CONTENT = f"list_filter({TOKENS}, lambda t: NOT list_contains({array(prep.STOP_WORDS)}, t))"
SENTENCES = r"list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
TERMS = f"list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: NOT list_contains({array(prep.STOP_WORDS)}, t))"
TRIMMED = r"regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')"


def lemma_sql(word: str) -> str:
    cases = [f"WHEN {word} = '{a}' THEN '{b}'" for a, b in prep.IRREGULAR_NOUNS.items()]
    cases += [f"WHEN length({word}) <= 3 THEN {word}"]
    cases += [
        f"WHEN ends_with({word}, '{e}') THEN left({word}, length({word}) - {len(e)}) || '{b}'"
        for e, b in prep.LEMMA_ENDINGS
    ]
    return f"CASE {' '.join(cases)} ELSE {word} END"


def documents(spark: SparkSession, base: str) -> DataFrame:
    return derived.source(spark, base, "documents").select(
        F.col("doc_id").alias("document_id"), "text", "lang", "source"
    )


@query("clean_text", f"SELECT doc_id AS document_id, {CLEAN} AS cleaned FROM documents")
def clean_text(spark: SparkSession, base: str) -> DataFrame:
    return documents(spark, base).select("document_id", prep.clean_text(F.col("text")).alias("cleaned"))


@query(
    "tokenize",
    f"""SELECT document_id, token, count(*) AS n FROM (
SELECT doc_id AS document_id, unnest({TOKENS}) AS token FROM documents) GROUP BY ALL""",
)
def tokenize(spark: SparkSession, base: str) -> DataFrame:
    tokens = prep.tokenize(prep.clean_text(F.col("text")))
    return (
        documents(spark, base)
        .select("document_id", F.explode(tokens).alias("token"))
        .groupBy("document_id", "token")
        .agg(F.count("*").alias("n"))
    )


@query(
    "remove_stopwords",
    f"SELECT doc_id AS document_id, array_to_string({CONTENT}, ' ') AS kept FROM documents",
)
def remove_stopwords(spark: SparkSession, base: str) -> DataFrame:
    tokens = prep.remove_stopwords(prep.tokenize(prep.clean_text(F.col("text"))))
    return documents(spark, base).select("document_id", F.array_join(tokens, " ").alias("kept"))


@query(
    "stopword_anti_join",
    f"""SELECT document_id, token, count(*) AS n FROM (
SELECT doc_id AS document_id, unnest({TOKENS}) AS token FROM documents)
WHERE token NOT IN {in_list(prep.STOP_WORDS)} GROUP BY ALL""",
)
def stopword_anti_join(spark: SparkSession, base: str) -> DataFrame:
    """Stop words as a table of fixed size, so the broadcast is bounded."""
    words = spark.createDataFrame([(w,) for w in prep.STOP_WORDS], "token string")
    tokens = prep.tokenize(prep.clean_text(F.col("text")))
    return (
        documents(spark, base)
        .select("document_id", F.explode(tokens).alias("token"))
        .join(F.broadcast(words), "token", "left_anti")
        .groupBy("document_id", "token")
        .agg(F.count("*").alias("n"))
    )


@query(
    "lemmatize",
    f"""SELECT word, {lemma_sql('word')} AS lemma FROM (
SELECT DISTINCT unnest({CONTENT}) AS word FROM documents)""",
)
def lemmatize(spark: SparkSession, base: str) -> DataFrame:
    words = prep.remove_stopwords(prep.tokenize(prep.clean_text(F.col("text"))))
    return tfidf.vocabulary(documents(spark, base), words).select("word", prep.lemma(F.col("word")).alias("lemma"))


@query(
    "preprocess_tokens",
    f"""SELECT doc_id AS document_id, len({CONTENT})::INTEGER AS processed_tokens,
array_to_string(list_transform({CONTENT}, lambda t: {lemma_sql('t')}), ' ') AS lemmas FROM documents""",
)
def preprocess_tokens(spark: SparkSession, base: str) -> DataFrame:
    done = documents(spark, base).select("document_id", prep.preprocess(F.col("text")).alias("t"))
    return done.select("document_id", F.size("t").alias("processed_tokens"), F.array_join("t", " ").alias("lemmas"))


@query(
    "sentence_split",
    f"""SELECT document_id, i::INTEGER AS position, ss[i] AS sentence FROM (
SELECT document_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM (
SELECT doc_id AS document_id, {SENTENCES} AS ss FROM documents))""",
)
def sentence_split(spark: SparkSession, base: str) -> DataFrame:
    return documents(spark, base).select(
        "document_id", F.posexplode(prep.sentences(F.col("text"))).alias("i", "sentence")
    ).select("document_id", (F.col("i") + 1).alias("position"), "sentence")


@query(
    "chunk_text",
    """SELECT doc_id AS document_id, i::INTEGER AS chunk, substr(text, i * 1024 + 1, 1024) AS text FROM (
SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 1024.0) AS BIGINT))) AS i FROM documents)""",
)
def chunk_text(spark: SparkSession, base: str) -> DataFrame:
    return documents(spark, base).select("document_id", F.posexplode(prep.chunks(F.col("text"))).alias("chunk", "text"))


@query(
    "filter_short_chunks",
    f"""SELECT document_id, chunk, length(text)::INTEGER AS chars FROM (
SELECT doc_id AS document_id, i::INTEGER AS chunk, substr(text, i * 1024 + 1, 1024) AS text FROM (
SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 1024.0) AS BIGINT))) AS i FROM documents))
WHERE length({TRIMMED}) >= 50""",
)
def filter_short_chunks(spark: SparkSession, base: str) -> DataFrame:
    numbered = F.transform(prep.chunks(F.col("text")), lambda c, i: F.struct(i.alias("chunk"), c.alias("text")))
    from docweave.functions.regex import strip

    kept = F.filter(numbered, lambda s: F.length(strip(s["text"])) >= 50)
    return documents(spark, base).select("document_id", F.inline(kept)).select(
        "document_id", "chunk", F.length("text").alias("chars")
    )


@query(
    "contains_keywords",
    f"{with_tables(texts=derived.TYPED)} SELECT document_id, "
    + ", ".join(f"contains(lower(text), '{w}') AS has_{w}" for w in ("invoice", "agreement", "experience", "dear"))
    + " FROM texts",
)
def contains_keywords(spark: SparkSession, base: str) -> DataFrame:
    low = F.lower("text")
    return derived.texts(spark, base, derived.TYPED).select(
        "document_id", *[low.contains(w).alias(f"has_{w}") for w in ("invoice", "agreement", "experience", "dear")]
    )


@query(
    "filter_min_text",
    f"""SELECT doc_id AS document_id, coalesce(length({TRIMMED}) >= 10, false) AS enough_for_nlp,
coalesce(length({TRIMMED}) > 10, false) AS enough_for_image FROM documents""",
)
def filter_min_text(spark: SparkSession, base: str) -> DataFrame:
    text = F.col("text")
    return documents(spark, base).select(
        "document_id",
        prep.enough_for_nlp(text).alias("enough_for_nlp"),
        prep.enough_for_image(text).alias("enough_for_image"),
    )


@query(
    "filter_nonempty_text",
    "SELECT doc_id AS document_id, length(text)::INTEGER AS chars FROM documents WHERE text IS NOT NULL AND text <> ''",
)
def filter_nonempty_text(spark: SparkSession, base: str) -> DataFrame:
    return documents(spark, base).where(prep.present(F.col("text"))).select(
        "document_id", F.length("text").alias("chars")
    )


def _preview_sql(n: int) -> str:
    return f"CASE WHEN length(text) > {n} THEN substr(text, 1, {n}) || '...' ELSE text END"


@query(
    "project_truncate",
    f"""SELECT doc_id AS document_id, {_preview_sql(100)} AS preview_100, {_preview_sql(200)} AS preview_200,
length(substr(text, 1, 1000))::INTEGER AS scored_chars FROM documents""",
)
def project_truncate(spark: SparkSession, base: str) -> DataFrame:
    text = F.col("text")
    return documents(spark, base).select(
        "document_id",
        prep.preview(text, 100).alias("preview_100"),
        prep.preview(text, 200).alias("preview_200"),
        F.length(F.substring(text, 1, 1000)).alias("scored_chars"),
    )


# --- vocabularies -----------------------------------------------------------------------------

SPACED = "list_filter(string_split_regex(text, '[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda w: w <> '')"
VOCAB = f"""SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS rank FROM (
  SELECT word, count(*) AS n FROM (SELECT unnest({SPACED}) AS word FROM documents) GROUP BY word)
  ORDER BY rank LIMIT 10000"""


def _spaced() -> F.Column:
    """Words between blanks of any script."""
    return F.filter(F.split("text", f"[{SPACE}]+"), lambda w: w != "")


@query("agg_vocabulary", VOCAB)
def agg_vocabulary(spark: SparkSession, base: str) -> DataFrame:
    top = tfidf.top_terms(documents(spark, base), _spaced(), 10_000)
    return top.select(F.col("term").alias("word"), "n", F.col("rank").cast("bigint").alias("rank"))


@query("distinct_vocabulary", f"""SELECT word, row_number() OVER (ORDER BY substr(md5(word), 1, 3), word) - 1 AS idx
FROM (SELECT DISTINCT unnest({SPACED}) AS word FROM documents)""")
def distinct_vocabulary(spark: SparkSession, base: str) -> DataFrame:
    """Distinct words with an index: numbered inside 4,096 digest buckets, not in one sort."""
    return word_index(spark, base).withColumn("idx", F.col("idx") - 1)


def word_index(spark: SparkSession, base: str) -> DataFrame:
    """``(word, idx)`` of the whole vocabulary, from 1."""
    words = tfidf.vocabulary(documents(spark, base), _spaced())
    words = words.withColumn("bucket", F.substring(F.md5("word"), 1, 3))
    return with_position(words, ["word"], [F.col("bucket")], "idx").select("word", (F.col("idx") + 1).alias("idx"))


INDEXED = f"""SELECT word, row_number() OVER (ORDER BY substr(md5(word), 1, 3), word) AS idx
FROM (SELECT DISTINCT unnest({SPACED}) AS word FROM documents)"""


@query(
    "vocab_lookup_join",
    f"""WITH v AS ({INDEXED}), w AS (
SELECT document_id, unnest(range(0, len(ws))) AS position, unnest(ws) AS word FROM (SELECT doc_id AS document_id, {SPACED} AS ws FROM documents))
SELECT document_id, position::INTEGER AS position, w.word, coalesce(v.idx, 0) AS idx FROM w LEFT JOIN v USING (word)""",
)
def vocab_lookup_join(spark: SparkSession, base: str) -> DataFrame:
    """Every word of every text by its place in the whole vocabulary, from 1; 0 is kept for padding."""
    return tfidf.encode_words(documents(spark, base), "document_id", _spaced(), word_index(spark, base))


@query(
    "topk_terms",
    f"""SELECT term, n, row_number() OVER (ORDER BY n DESC, term)::INTEGER AS rank FROM (
  SELECT term, count(*) AS n FROM (SELECT unnest({TERMS}) AS term FROM documents) GROUP BY term)
  ORDER BY rank LIMIT 1000""",
)
def topk_terms(spark: SparkSession, base: str) -> DataFrame:
    return tfidf.top_terms(documents(spark, base), prep.terms(F.col("text")), 1000)


@query(
    "pad_sequence",
    f"""WITH v AS ({INDEXED}), w AS (
SELECT document_id, unnest(range(0, len(ws))) AS position, unnest(ws) AS word FROM (SELECT doc_id AS document_id, {SPACED} AS ws FROM documents)),
i AS (SELECT document_id, list(idx ORDER BY position) AS ids FROM w JOIN v USING (word) GROUP BY document_id),
d AS (SELECT doc_id AS document_id, coalesce(ids, []::BIGINT[]) AS ids FROM documents LEFT JOIN i ON doc_id = document_id)
SELECT document_id, array_to_string(list_concat(ids[1:100], list_transform(range(0, 100 - len(ids[1:100])), lambda x: 0::BIGINT)), ',') AS post,
  array_to_string(list_concat(list_transform(range(0, 500 - least(len(ids), 500)), lambda x: 0::BIGINT), CASE WHEN len(ids) > 500 THEN ids[-500:] ELSE ids END), ',') AS pre
FROM d""",
)
def pad_sequence(spark: SparkSession, base: str) -> DataFrame:
    """Vocabulary ids of every text, brought to 100 from the front and to 500 from the end."""
    docs = documents(spark, base)
    coded = tfidf.encode_words(docs, "document_id", _spaced(), word_index(spark, base))
    # A document's words, which its text held in one row before.
    listed = F.array_sort(F.collect_list(F.struct("position", "idx")))
    per = coded.groupBy("document_id").agg(F.transform(listed, lambda w: w["idx"]).alias("ids"))
    ids = F.coalesce("ids", F.array().cast("array<bigint>"))
    padded = docs.select("document_id").join(per, "document_id", "left")
    return padded.select(
        "document_id", F.array_join(prep.pad_post(ids), ",").alias("post"), F.array_join(prep.pad_pre(ids), ",").alias("pre")
    )


@query("hash_bucket")
def hash_bucket(spark: SparkSession, base: str) -> DataFrame:
    """Words per bucket; stable between runs, unlike a salted hash."""
    words = documents(spark, base).select(F.explode(_spaced()).alias("word"))
    return words.groupBy(prep.hash_bucket(F.col("word")).alias("bucket")).agg(F.count("*").alias("words"))


# --- protection -------------------------------------------------------------------------------

KEY = "0123456789abcdef"


@query(
    "encrypt_column",
    "SELECT c_custkey, c_name AS restored, true AS hidden, true AS wrong_key_is_empty FROM customer",
)
def encrypt_column(spark: SparkSession, base: str) -> DataFrame:
    token = privacy.encrypt(F.col("c_name"), F.lit(KEY))
    return load(spark, base, "customer").select("c_custkey", "c_name", token.alias("token")).select(
        "c_custkey",
        privacy.decrypt(F.col("token"), F.lit(KEY)).alias("restored"),
        (~F.col("token").contains(F.col("c_name"))).alias("hidden"),
        (privacy.decrypt(F.col("token"), F.lit(KEY[::-1])) == "").alias("wrong_key_is_empty"),
    )


@query(
    "decrypt_column",
    "SELECT c_custkey, '' AS from_junk, c_name AS restored FROM customer",
)
def decrypt_column(spark: SparkSession, base: str) -> DataFrame:
    name = F.col("c_name")
    return load(spark, base, "customer").select(
        "c_custkey",
        privacy.decrypt(name, F.lit(KEY)).alias("from_junk"),
        privacy.decrypt(privacy.encrypt(name, F.lit(KEY)), F.lit(KEY)).alias("restored"),
    )


@query("hash_column", "SELECT c_custkey, sha256('pepper' || c_name) AS pseudonym FROM customer")
def hash_column(spark: SparkSession, base: str) -> DataFrame:
    return load(spark, base, "customer").select(
        "c_custkey", privacy.pseudonym(F.col("c_name"), F.lit("pepper")).alias("pseudonym")
    )


@query(
    "verify_hash",
    "SELECT c_custkey, true AS same, false AS other FROM customer",
)
def verify_hash(spark: SparkSession, base: str) -> DataFrame:
    name, salt = F.col("c_name"), F.lit("pepper")
    kept = load(spark, base, "customer").select("c_custkey", "c_name", privacy.pseudonym(name, salt).alias("digest"))
    return kept.select(
        "c_custkey",
        privacy.matches_pseudonym(name, salt, F.col("digest")).alias("same"),
        privacy.matches_pseudonym(F.upper(name), salt, F.col("digest")).alias("other"),
    )


def _redacted() -> str:
    out = "text"
    for name in ("ssn", "credit_card", "email", "phone"):
        out = f"regexp_replace({out}, {re2(PATTERNS[name])}, {literal('[' + name.upper() + ']')}, 'g')"
    return out


@query("redact_pii", f"{with_tables(texts=derived.TEXTS)} SELECT document_id, {_redacted()} AS redacted FROM texts")
def redact_pii(spark: SparkSession, base: str) -> DataFrame:
    return derived.texts(spark, base).select("document_id", privacy.redact(F.col("text")).alias("redacted"))
