"""Connected components of an edge table, by contraction: no group of neighbours is ever collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.store import drop, keep


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of ``edges`` (a, b: long).

    Each round points every node at its smallest neighbour, follows the pointers a few steps and
    contracts; the number of rounds grows with the logarithm of a component's size. Rounds are written
    to the shared folder.
    """
    both = edges.where("a <> b").select("a", "b")
    left = keep(both.union(both.select("b", "a")).distinct(), "edges")
    labels = None
    while True:
        parent = left.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("to"))
        parent = keep(parent, "parents")
        for _ in range(2):
            after = parent.select(F.col("node").alias("to"), F.col("to").alias("next"))
            parent = parent.join(after, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
        parent = keep(parent, "parents")
        if labels is None:
            labels = parent.select("node", F.col("to").alias("component"))
        else:
            step = parent.select(F.col("node").alias("component"), "to")
            labels = labels.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = keep(labels, "labels")
        old = left
        for end in ("a", "b"):
            step = parent.select(F.col("node").alias(end), F.col("to").alias(f"{end}2"))
            left = left.join(step, end).drop(end)
        left = keep(left.select(F.col("a2").alias("a"), F.col("b2").alias("b")).where("a <> b").distinct(), "edges")
        drop(old, parent)
        if left.isEmpty():
            return labels
