"""Near-duplicate documents of a corpus: a set-similarity join by prefixes, without pairs of a group.

1. A document is the set of its runs of ``SIZE`` terms. Equal sets are one class, held by one row.
2. The runs have one order for the whole corpus: rare ones first. Two sets that share enough must share
   one of the first few of each (the prefix), so only those are listed. Runs that a single class holds
   come first and are never listed.
3. Classes in one list are compared if their lengths, and what is left after their places in the list,
   allow the similarity. That is not done for all of them: in a few rounds each compares itself to one
   member of its list, and what is similar is one group from then on. At the end, in lists that still hold
   several groups, everything outside the largest group is compared with everything of other groups.

No two members of a group are compared to each other once they are known to be in one group, and none are
written out as pairs; yet no link between two groups is missed, as one of its ends is outside the largest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.regex import let
from docweave.functions.text import terms
from docweave.operators.graph import connected
from docweave.sources.stored import stored

SIZE, PERCENT = 5, 80
ROUNDS = 4  # at most; the last comparison is whole after any number of them
ENOUGH = 20  # comparisons a listed class may cost at the end without another round


def runs(text: Column, size: int = SIZE) -> Column:
    """Distinct hashes of all runs of ``size`` terms, sorted; of fewer terms the whole is one run."""

    def cut(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - size + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(size)), " ")))

    found = let(terms(F.coalesce(text, F.lit(""))), lambda w: F.when(F.size(w) > 0, cut(w)))
    return F.array_sort(F.array_distinct(F.coalesce(found, F.array().cast("array<bigint>"))))


def classes(documents: DataFrame, key: str, size: int) -> tuple[DataFrame, DataFrame]:
    """``(key, class)`` of every document, and ``(class, n, runs)`` of every class that has runs.

    The class is a 128-bit digest of the set, NULL for an empty one.
    """
    own = documents.select(key, runs(F.col("text"), size).alias("runs"))
    name = F.when(F.size("runs") > 0, F.unhex(F.md5(F.array_join(F.col("runs").cast("array<string>"), " "))))
    own = stored(own.select(key, name.alias("class"), "runs"), "runs")
    known = own.where("class IS NOT NULL").groupBy("class").agg(F.first("runs").alias("runs"))
    return own.select(key, "class"), stored(known.select("class", F.size("runs").alias("n"), "runs"), "classes")


def lists(known: DataFrame, percent: int) -> DataFrame:
    """``(run, class, n, place)``: the prefix of every class, without runs that only it holds."""
    held = known.select("class", "n", F.explode("runs").alias("run"))
    # Counted where they lie, so that each run of a class is shuffled once.
    common = held.withColumn("classes", F.count("*").over(Window.partitionBy("run"))).where("classes > 1")
    shared = common.groupBy("class", "n").agg(F.sort_array(F.collect_list(F.struct("classes", "run"))).alias("shared"))
    # Of n runs, n - ceil(t n) + 1 are the prefix; those that nobody shares fill its first places.
    alone = F.col("n") - F.size("shared")
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    first = F.slice("shared", F.lit(1), F.greatest(prefix - alone, F.lit(0)))
    listed = shared.select("class", "n", alone.alias("alone"), F.posexplode(first).alias("i", "s"))
    return listed.select(F.col("s.run").alias("run"), "class", "n", (F.col("alone") + F.col("i")).alias("place"))


def _allowed(percent: int) -> Column:
    """Whether the lengths of ``a`` and ``b``, and what follows their common run, allow the similarity.

    Their first common run passes whenever the pair is similar, so nothing is lost at later ones.
    """
    n, m = F.col("a.n"), F.col("b.n")
    rest = F.least(n - F.col("a.place"), m - F.col("b.place"))
    lengths = (100 * F.least(n, m)) >= percent * F.greatest(n, m)
    return lengths & (rest * (100 + percent) >= percent * (n + m))


def similarity(a: Column, b: Column) -> Column:
    """Shared runs by all runs of two sets."""
    return let(F.size(F.array_intersect(a, b)), lambda both: both / (F.size(a) + F.size(b) - both))


def _similar(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that reach the similarity, by their whole sets."""
    left = known.select(F.col("class").alias("a"), F.col("runs").alias("ra"))
    right = known.select(F.col("class").alias("b"), F.col("runs").alias("rb"))
    both = F.size(F.array_intersect("ra", "rb"))
    every = F.size("ra") + F.size("rb")
    return pairs.distinct().join(left, "a").join(right, "b").where(both * (100 + percent) >= percent * every).select("a", "b")


def _grouped(listed: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Lists with the group of every class; a class without links is a group of its own."""
    if roots is None:
        return listed.withColumn("group", F.col("class"))
    own = roots.select(F.col("node").alias("class"), "root")
    return listed.join(own, "class", "left").select(*listed.columns, F.coalesce("root", "class").alias("group"))


def links(known: DataFrame, percent: int = PERCENT) -> DataFrame | None:
    """``(node, root)`` of all classes that are linked to another one; None if there are none."""
    listed = stored(lists(known, percent), "prefixes")
    found, roots = None, None

    def more(pairs: DataFrame) -> bool:
        nonlocal found, roots
        new = stored(_similar(pairs, known, percent), "similar")
        if new.isEmpty():
            return False
        found = new if found is None else found.union(new)
        roots = connected(found)
        return True

    for number in range(ROUNDS):
        now = stored(_grouped(listed, roots), "grouped")
        per = now.groupBy("run", "group").agg(F.count("*").alias("k")).groupBy("run").agg(F.sum("k").alias("all"), F.max("k").alias("most"))
        work = per.agg(F.sum((F.col("all") - F.col("most")) * F.col("all")).alias("w"), F.sum("all").alias("n")).first()
        if not work["w"]:
            return roots
        if number and work["w"] <= ENOUGH * work["n"]:
            break
        # Another member of the list each time, of about the same length.
        band = F.floor(F.log(F.col("n") + 0.5 * (number % 2)) / -F.log(F.lit(percent / 100)))
        by = F.xxhash64("class", F.lit(number))
        placed = now.select("run", "class", "group", band.alias("band"), by.alias("by"))
        centre = placed.groupBy("run", "band").agg(F.min_by(F.struct("class", "group"), "by").alias("c"), F.count("*").alias("k")).where("k > 1")
        pairs = placed.join(centre, ["run", "band"]).where("group <> c.group")
        if not more(pairs.select(F.col("class").alias("a"), F.col("c.class").alias("b"))):
            break
    now = stored(_grouped(listed, roots), "grouped")
    per = now.groupBy("run", "group").agg(F.count("*").alias("k")).groupBy("run")
    largest = per.agg(F.max_by("group", F.struct("k", "group")).alias("largest"), F.count("*").alias("groups")).where("groups > 1")
    open_ = stored(now.join(largest.select("run", "largest"), "run"), "open")
    outside = open_.where("group <> largest")
    # Of two outside the largest group, one side is enough.
    once = (F.col("b.group") == F.col("b.largest")) | (F.col("a.class") < F.col("b.class"))
    meet = (F.col("a.run") == F.col("b.run")) & (F.col("a.group") != F.col("b.group")) & once & _allowed(percent)
    pairs = outside.alias("a").join(open_.alias("b"), meet)
    more(pairs.select(F.col("a.class").alias("a"), F.col("b.class").alias("b")))
    return roots


def near_duplicates(documents: DataFrame, key: str = "document_id", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """``(key, class_id, representative, similarity)``, one row a document.

    ``class_id``: the smallest key with the same set. ``representative``: the smallest key of the group that
    links of ``percent`` or more lead to; ``similarity``: of the document's set and that one's, which is less
    where a chain of links lies between them. Documents without terms are alone, with similarity NULL.
    """
    own, known = classes(documents, key, size)
    roots = links(known, percent)
    least = own.where("class IS NOT NULL").groupBy("class").agg(F.min(key).alias("class_id"))
    if roots is None:
        out = least.select("class", "class_id", F.col("class_id").alias("representative"), F.lit(1.0).alias("similarity"))
    else:
        joined = stored(least.join(roots.withColumnRenamed("node", "class"), "class", "left"), "members")
        heads = joined.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("class_id", "class")).alias("head"))
        heads = heads.join(known.select(F.col("class").alias("head_class"), F.col("runs").alias("head_runs")), F.col("head.class") == F.col("head_class"))
        grouped = joined.where("root IS NOT NULL").join(known.select("class", "runs"), "class").join(heads, "root")
        grouped = grouped.select("class", "class_id", F.col("head.class_id").alias("representative"), similarity(F.col("runs"), F.col("head_runs")).alias("similarity"))
        single = joined.where("root IS NULL").select("class", "class_id", F.col("class_id").alias("representative"), F.lit(1.0).alias("similarity"))
        out = grouped.union(single)
    return own.join(out, "class", "left").select(
        key, F.coalesce("class_id", key).alias("class_id"), F.coalesce("representative", key).alias("representative"), "similarity"
    )
