"""Connected groups of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.sources.stored import stored


def connected(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; the root is the smallest node of its group.

    Every round hangs each node on the smallest one it touches, lets it climb to where that one hangs,
    and links only what the round has not brought together. Links that lie inside a tree are dropped, so
    the table shrinks, and a chain halves at least. Rounds end lineage in the shared folder.
    """
    both = links.where("a <> b").select("a", "b")
    left = stored(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    roots = None
    while True:
        hung = stored(left.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "hung")
        for _ in range(2):
            above = hung.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            hung = hung.join(above, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
        hung = stored(hung, "hung")
        if roots is None:
            roots = hung
        else:
            step = hung.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            roots = stored(roots.join(step, "root", "left").select("node", F.coalesce("higher", "root").alias("root")), "roots")
        one = hung.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        other = hung.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = left.join(one, "a").join(other, "b").where("ra <> rb")
        left = stored(left.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
        if left.isEmpty():
            return roots
