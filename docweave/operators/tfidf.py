"""TF-IDF and what is ranked by it: summaries, similarity, key phrases, vocabularies.

Weights follow the smoothed form ``tf * (ln((1 + n) / (1 + df)) + 1)``, rows scaled to length one.
Scores are rounded to nine digits before ranking, because the order of a floating-point sum depends
on the partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from docweave.functions.regex import let, strip
from docweave.functions.text import chunks, sentences, terms
from docweave.operators import phrases
from docweave.operators.skew import hot_salted_join
from docweave.sources.stored import stored
from docweave.sources.tables import partitions


def idf(n: Column, df: Column) -> Column:
    return F.log((1.0 + n) / (1.0 + df)) + 1.0


def _starts(values: Column, item: Callable[[Column], Column] = lambda v: v) -> Column:
    """Where the runs of equal items of a sorted array begin."""
    return F.filter(
        F.sequence(F.lit(0), F.size(values) - 1),
        lambda i: ~item(F.get(values, i)).eqNullSafe(item(F.get(values, i - 1))),
    )


def _run(starts: Column, place: Column, size: Column) -> Column:
    """Length of the run that begins at ``starts[place]``."""
    return F.coalesce(F.get(starts, place + 1), size) - F.get(starts, place)


def counted(items: Column) -> Column:
    """``ARRAY<STRUCT<term,tf>>``: the distinct items of an array and how often each is there; NULL if it has none."""

    def runs(values: Column) -> Column:
        return let(
            _starts(values),
            lambda starts: F.transform(
                starts,
                lambda i, k: F.struct(F.get(values, i).alias("term"), _run(starts, k, F.size(values)).cast("bigint").alias("tf")),
            ),
        )

    return F.when(F.size(items) > 0, let(F.sort_array(items), runs))


def sentence_terms(parts: Column) -> Column:
    """``ARRAY<STRUCT<sentence,tf,df>>``: an entry for every term of every sentence, and one more a sentence.

    ``tf`` counts the term in the sentence, ``df`` the sentences that hold it; both are NULL in the entry more,
    which keeps sentences without terms. Terms are told apart by 64-bit hashes, which are sorted faster than strings.
    """
    pairs = F.flatten(F.transform(parts, lambda s, i: F.transform(terms(s), lambda t: F.struct(F.xxhash64(t).alias("term"), i.alias("i")))))

    def by_sentence(values: Column) -> Column:
        return let(
            _starts(values),
            lambda starts: F.transform(
                starts,
                lambda i, k: F.struct(
                    F.get(values, i)["term"].alias("term"), F.get(values, i)["i"].alias("i"), _run(starts, k, F.size(values)).alias("tf")
                ),
            ),
        )

    def by_term(found: Column) -> Column:
        def one(starts: Column) -> Column:
            def held(i: Column, k: Column) -> Column:
                n = _run(starts, k, F.size(found))
                return F.transform(
                    F.slice(found, i + 1, n), lambda f: F.struct(f["i"].alias("sentence"), f["tf"].alias("tf"), n.alias("df"))
                )

            return F.flatten(F.transform(starts, held))

        return let(_starts(found, lambda f: f["term"]), one)

    kind = "array<struct<sentence:int,tf:int,df:int>>"
    none = F.transform(parts, lambda _, i: F.struct(i.alias("sentence"), F.lit(None).alias("tf"), F.lit(None).alias("df"))).cast(kind)
    some = let(pairs, lambda p: F.when(F.size(p) > 0, let(let(F.sort_array(p), by_sentence), by_term)))
    return F.concat(none, F.coalesce(some.cast(kind), F.array().cast(kind)))


def extractive_summary(
    df: DataFrame, keys: Sequence[str] = ("document_id",), text_col: str = "text", size: int = 3
) -> DataFrame:
    """The ``size`` best sentences of every document, in document order.

    Terms, document frequencies, norms and ranks all belong to one document, so the texts are
    shuffled once by the keys and every later grouping and window reuses that placement. Terms are counted
    inside the row, so a task holds one document's terms and otherwise a row for every sentence.
    A text of at most ``size`` sentences is its own summary; one without any usable term gets an
    error instead.
    """
    keys = list(keys)
    placed = df.select(*keys, F.col(text_col).alias("_text")).repartition(partitions(df), *keys)
    parts = placed.withColumn("_s", sentences(F.col("_text")))
    weight = F.coalesce(F.col("_c.tf") * idf(F.col("_n"), F.col("_c.df")), F.lit(0.0))
    scores = (
        parts.where(F.size("_s") > size)
        .select(*keys, F.size("_s").alias("_n"), F.explode(sentence_terms(F.col("_s"))).alias("_c"))
        .select(*keys, F.col("_c.sentence").alias("_i"), weight.alias("_w"))
        .groupBy(*keys, "_i")
        .agg(F.sum("_w").alias("_sum"), F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
        .select(
            *keys,
            "_i",
            F.when(F.col("_norm") > 0, F.round(F.col("_sum") / F.col("_norm"), 9))
            .otherwise(0.0)
            .alias("_score"),
        )
    )
    best_first = W.Window.partitionBy(*keys).orderBy(F.desc("_score"), F.desc("_i"))
    top = (
        scores.withColumn("_rank", F.row_number().over(best_first))
        .where(F.col("_rank") <= size)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list("_i")).alias("_top"), F.max("_score").alias("_best"))
    )
    joined = parts.join(top, keys, "left")
    picked = F.array_join(F.transform(F.col("_top"), lambda i: F.col("_s")[i]), " ")
    short = F.coalesce(F.size("_s") <= size, F.lit(True))
    empty = ~short & (F.col("_best") <= 0)
    return joined.select(
        *keys,
        F.when(short, F.col("_text")).when(~empty, picked).alias("summary"),
        F.when(empty, "empty vocabulary").alias("error"),
    )


def chunked_summary(
    df: DataFrame, key: str = "document_id", size: int = 1024, minimum: int = 50
) -> DataFrame:
    """Summary of every chunk, joined in order; of texts of several chunks, too short ones are left out.

    Chunks don't depend on each other, so each is placed by document and chunk.
    """
    text = F.col("text")
    pieces = df.select(
        key, (F.length(text) <= size).alias("_whole"), F.posexplode(chunks(text, size)).alias("chunk", "text")
    ).where(F.col("_whole") | (F.length(strip(F.col("text"))) >= minimum))
    per_chunk = extractive_summary(pieces.drop("_whole"), [key, "chunk"])
    ordered = F.sort_array(F.collect_list(F.struct("chunk", "summary")))
    return per_chunk.groupBy(key).agg(
        F.array_join(F.transform(ordered, lambda s: s["summary"]), " ").alias("summary"),
        F.count("*").alias("chunks"),
    )


def pair_similarity(
    pairs: DataFrame, key: Sequence[str], left: str, right: str, max_terms: int | None = None
) -> DataFrame:
    """Cosine of two texts whose weights are fitted on just these two.

    With two documents a shared term weighs 1 and any other ``ln(1.5) + 1``, so one grouping by
    pair and term is enough. ``max_terms`` limits the vocabulary to the pair's most frequent terms.
    """
    key = list(key)
    side = F.concat(
        F.transform(terms(F.col(left)), lambda t: F.struct(t.alias("term"), F.lit(1).alias("a"), F.lit(0).alias("b"))),
        F.transform(terms(F.col(right)), lambda t: F.struct(t.alias("term"), F.lit(0).alias("a"), F.lit(1).alias("b"))),
    )
    counts = (
        pairs.select(*key, left, right)
        .repartition(*key)
        .select(*key, F.explode_outer(side).alias("t"))
        .groupBy(*key, F.col("t.term").alias("term"))
        .agg(F.coalesce(F.sum("t.a"), F.lit(0)).alias("a"), F.coalesce(F.sum("t.b"), F.lit(0)).alias("b"))
    )
    kept = counts
    if max_terms is not None:
        frequent = W.Window.partitionBy(*key).orderBy(F.desc(F.col("a") + F.col("b")), F.asc("term"))
        kept = counts.withColumn("_rank", F.row_number().over(frequent)).where(F.col("_rank") <= max_terms)
    weight = F.when((F.col("a") > 0) & (F.col("b") > 0), F.lit(1.0)).otherwise(F.log(F.lit(1.5)) + 1.0)
    sums = (
        kept.withColumn("w", weight)
        .groupBy(*key)
        .agg(
            F.sum(F.col("a") * F.col("b")).alias("dot"),
            F.sum(F.pow(F.col("a") * F.col("w"), 2)).alias("aa"),
            F.sum(F.pow(F.col("b") * F.col("w"), 2)).alias("bb"),
        )
    )
    cosine = F.when(
        (F.col("aa") > 0) & (F.col("bb") > 0), F.col("dot") / (F.sqrt("aa") * F.sqrt("bb"))
    ).otherwise(0.0)
    return sums.select(*key, cosine.alias("similarity"))


PARTS = 2  # of a corpus' terms for every part that its texts would be dealt out in


def term_counts(df: DataFrame, key: str, items: Column, carry: Sequence[str] = ()) -> DataFrame:
    """``(key, term, tf)`` of an array of terms per document.

    Terms are counted inside the row; rows are only brought together where a key has several.
    """
    df = df.select(key, *carry, counted(items).alias("_c"))
    return _entries(df, key, carry)


def _entries(df: DataFrame, key: str, carry: Sequence[str] = ()) -> DataFrame:
    rows = df.select(key, *carry, F.explode("_c").alias("_c")).select(key, *carry, "_c.term", "_c.tf")
    if df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return rows
    return rows.groupBy(key, *carry, "term").agg(F.sum("tf").alias("tf"))


def tfidf(df: DataFrame, key: str = "document_id", text_col: str = "text") -> DataFrame:
    """``(key, term, tf, df, weight)`` over a corpus; weights of a document have length one."""
    return normalise(weights(df, key, terms(F.col(text_col))), key)


def weights(df: DataFrame, key: str, items: Column) -> DataFrame:
    """Unscaled TF-IDF weights, placed by document. Document frequencies come back by a join.

    Terms are counted once and the counts of each document written as they are: they are read for the frequencies
    and for the join, and to count them costs far more. A term has one row per document it is in. Terms in more than a fiftieth of the documents are
    salted; a document of ``m`` terms leaves room for at most ``50 m`` of them on average.
    """
    counts = stored(df.select(key, counted(items).alias("_c")), "counts")
    tf = _entries(counts, key)
    n = counts.select(F.count("*").alias("n")).scalar()
    freq = tf.groupBy("term").agg(F.count("*").alias("df"))
    parts = PARTS * partitions(df)
    joined = hot_salted_join(tf, freq, "term", "df", n / 50.0, key, parts=parts)
    return joined.withColumn("weight", F.col("tf") * idf(n, F.col("df"))).repartition(parts, key)


def normalise(weighted: DataFrame, key: str) -> DataFrame:
    square = F.sum(F.col("weight") * F.col("weight")).over(W.Window.partitionBy(key))
    return weighted.withColumn("weight", F.col("weight") / F.sqrt(square))


def key_phrases(df: DataFrame, key: str = "document_id", top: int = 5) -> DataFrame:
    """The ``top`` words and word pairs of every document by TF-IDF; what cannot be among them is left in its block."""
    found, n = phrases.candidates(df, key, top)
    scored = found.withColumn("score", F.round(F.col("tf") * idf(F.lit(n), F.col("df")), 9))
    best = W.Window.partitionBy(key).orderBy(F.desc("score"), F.asc("term"))
    return (
        scored.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= top)
        .select(key, "rank", F.col("term").alias("phrase"), "score")
    )


def top_terms(df: DataFrame, items: Column, size: int) -> DataFrame:
    """The ``size`` most frequent terms with their rank, ties by term.

    Counting is pre-aggregated and the cut is a distributed top-k; only the ``size`` rows that are
    left are numbered in one place.
    """
    counted = df.select(F.explode(items).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    kept = counted.orderBy(F.desc("n"), F.asc("term")).limit(size)
    return kept.withColumn(
        "rank", F.row_number().over(W.Window.orderBy(F.desc("n"), F.asc("term")))
    )


def vocabulary(df: DataFrame, words: Column) -> DataFrame:
    """Distinct words of a corpus."""
    return df.select(F.explode(words).alias("word")).distinct()


def encode_words(df: DataFrame, key: str, words: Column, index: DataFrame) -> DataFrame:
    """``(key, position, word, idx)``: index of every word, 0 where the vocabulary lacks it.

    Whether the index is broadcast is left to its measured size; a hot word's rows are split by Spark.
    """
    long = df.select(key, F.posexplode(words).alias("position", "word"))
    return long.join(index, "word", "left").select(
        key, "position", "word", F.coalesce("idx", F.lit(0).cast("bigint")).alias("idx")
    )
