"""URL filters: listed rules, and gradient-boosted trees on lexical features for all other URLs.

A rule is a host and a path. It fits its host and all subdomains when the URL's path starts with the
rule's; the longest rule that fits decides. The trees are trained on the URLs that rules decide, at most
``MAX_LABELLED`` distinct ones taken by a hash; their features are lengths, depth, digit ratio, entropy,
numbers of parameters, and statistics of the host's last label over all URLs: how common it is and how
often its decided URLs are blocked. A decided URL is told the latter by the URLs of other folds alone.

A URL that is null or has no ``://`` has an empty host and path and no rule; it is judged by its features
like any other, and blocked from a probability of 0.5 on, both classes weighing the same. Without two classes to learn from, the only class is everyone's verdict, or allow.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.store import alone, drop, keep

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
MAX_LABELLED = 20_000
TREES, DEPTH = 12, 4
FOLDS = 5  # of the decided URLs, by a hash of the URL
COMMON = 1000  # a suffix with less than this part of all URLs shares its statistics with the others like it
FEATURES = (
    "length", "host_length", "path_length", "depth", "host_depth", "digit_ratio", "mark_ratio", "entropy", "parameters", "query_length",
    "suffix_share", "suffix_blocked",
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits and its verdict, or null."""
    fitting = []
    for verdict, rule in rules:
        of_host, _, of_path = rule.partition("/")
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith("/" + of_path)
        fitting.append(F.when(fits, F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fitting))


def _entropy(text: Column) -> Column:
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    chars = F.array_distinct(F.split(text, ""))
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(chars, F.lit(0.0), lambda s, c: s - F.when(share(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))


def features(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, ruled (rule and verdict, or null), and the lexical features."""
    url = F.coalesce("url", F.lit(""))
    host, path = host_and_path(F.col("url"))
    rows = alone(pages, "page_id", "url").select("page_id", F.xxhash64("url").alias("key"), url.alias("u"), host.alias("host"), path.alias("path"))
    size = F.greatest(F.length("u"), F.lit(1))
    query = F.regexp_extract("u", r"(?s)\?([^#]*)", 1)
    count = lambda pattern: F.regexp_count("u", F.lit(pattern))
    rows = rows.withColumns(
        {
            "ruled": rule_of(F.col("host"), F.col("path"), rules),
            "suffix": F.substring_index("host", ".", -1),
            "length": F.length("u"),
            "host_length": F.length("host"),
            "path_length": F.length("path"),
            "depth": F.regexp_count("path", F.lit("/[^/]")),
            "host_depth": F.regexp_count("host", F.lit("[.]")),
            "digit_ratio": count("[0-9]") / size,
            "mark_ratio": count("[^A-Za-z0-9]") / size,
            "entropy": _entropy(F.col("u")),
            "parameters": F.regexp_count(query, F.lit("[^&]+")),
            "query_length": F.length(query),
        }
    )
    return rows.drop("u")


def _statistics(rows: DataFrame, blocked: Column) -> tuple[DataFrame, tuple[int, int, int]]:
    """suffix, n, and by fold how many URLs the rules decide and block: common suffixes, and the rest as one (null).

    A common suffix has a ``COMMON``th of the URLs or more, so there are at most as many.
    """
    ruled = F.col("ruled").isNotNull()
    by_fold = lambda what: F.array(*[F.count_if(what & (F.col("fold") == k)) for k in range(FOLDS)])
    total = rows.agg(F.count("*"), F.count_if(ruled), F.count_if(blocked)).first()
    per = rows.groupBy("suffix").agg(F.count("*").alias("n"), by_fold(ruled).alias("decided"), by_fold(blocked).alias("bad"))
    common = F.when(F.col("n") * COMMON >= total[0], F.col("suffix"))
    added = lambda c: F.array(*[F.sum(F.col(c)[k]) for k in range(FOLDS)]).alias(c)
    pooled = per.groupBy(common.alias("suffix")).agg(F.sum("n").alias("n"), added("decided"), added("bad"))
    return keep(pooled, "suffixes"), tuple(int(x) for x in total)


def with_statistics(rows: DataFrame, blocked: Column, held: int | None) -> tuple[DataFrame, tuple[int, int, int]]:
    """``rows`` with suffix_share and suffix_blocked, and how many rows there are, decided and blocked.

    What a decided URL is told of its suffix comes from the other folds' URLs only, so never from its own rule.
    """
    per, (n, decided, bad) = _statistics(rows, blocked)
    prior = (bad + 1) / (decided + 2)
    known = F.broadcast(per.where("suffix IS NOT NULL"))
    rest = F.broadcast(per.where("suffix IS NULL").select(*[F.col(c).alias(f"rest_{c}") for c in ("n", "decided", "bad")]).limit(1))
    rows = rows.join(known, "suffix", "left").join(rest, F.lit(True), "left")
    of = lambda c: F.coalesce(F.col(c), F.col(f"rest_{c}"))
    own = F.when(F.col("ruled").isNotNull(), F.col("fold")).otherwise(-1)

    def others(column: str) -> Column:
        return F.aggregate(
            F.transform(of(column), lambda x, k: F.when((k == own) | (k == (-1 if held is None else held)), 0).otherwise(x)), F.lit(0).cast("long"), lambda s, x: s + x
        )

    rows = rows.withColumns(
        {
            "suffix_share": of("n") / max(n, 1),
            "suffix_blocked": (others("bad") + 5 * F.lit(prior)) / (others("decided") + 5),
        }
    )
    drop_columns = [c for c in rows.columns if c in ("n", "decided", "bad") or c.startswith("rest_")]
    return rows.drop(*drop_columns), (n, decided, bad)


def judge(pages: DataFrame, rules=RULES, max_labelled: int = MAX_LABELLED, held: int | None = None) -> DataFrame:
    """page_id, host, path, rule (null if none fits), verdict, and p_block: the trees' probability (null where ruled).

    With ``held``, a fold from 0 to ``FOLDS`` - 1, nothing is learned from the decided URLs of that fold, and they
    have a p_block too, by which the trees can be measured.
    """
    rows = keep(features(pages, rules).withColumn("fold", F.pmod(F.xxhash64("key", F.lit(11)), F.lit(FOLDS)).cast("int")), "urls")
    blocked = F.coalesce(F.col("ruled.verdict") == "block", F.lit(False))
    rows, (n, decided, bad) = with_statistics(rows, blocked, held)
    out = ["page_id", "host", "path", F.col("ruled.rule").alias("rule")]
    if not 0 < bad < decided:
        other = F.lit("block" if bad else "allow")
        return rows.select(*out, F.coalesce("ruled.verdict", other).alias("verdict"), F.lit(None).cast("double").alias("p_block"))
    numbers = [F.col(c).cast("double").alias(c) for c in FEATURES]
    taught = rows.where("ruled IS NOT NULL").where(F.lit(True) if held is None else F.col("fold") != held).groupBy("key").agg(F.first(F.struct(blocked.cast("double").alias("label"), *numbers)).alias("x"))
    taught = keep(taught.orderBy(F.xxhash64("key"), "key").limit(max_labelled).select("x.*"), "labelled-urls")
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, subsamplingRate=1.0, weightCol="weight")
    # Both classes weigh the same: how much the rules block says nothing about the URLs that they leave open.
    weight = F.when(F.col("label") == 1, decided / (2 * bad)).otherwise(decided / (2 * (decided - bad))).alias("weight")
    model = trees.fit(assemble.transform(taught.coalesce(2)).select("features", "label", weight))
    drop(taught)
    plain = rows.select("page_id", "host", "path", "ruled", "fold", *numbers)
    scored = model.transform(assemble.transform(plain))
    told = F.col("ruled").isNull() if held is None else F.col("ruled").isNull() | (F.col("fold") == held)
    p = F.when(told, vector_to_array("probability")[1])
    learned = F.when(p >= 0.5, "block").otherwise("allow")
    return scored.select(*out, F.coalesce("ruled.verdict", learned).alias("verdict"), p.alias("p_block"))
