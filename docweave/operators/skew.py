"""Joins and positions that stay spread out when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from docweave.sources.stored import stored


def hot_salted_join(
    facts: DataFrame, lookup: DataFrame, on: str, weight: str, limit: Column, spread: str, salts: int = 64, parts: int | None = None
) -> DataFrame:
    """Join a large side to a lookup of one row per key that knows how many facts each has (``weight``).

    Rows of a hot key are spread by a hash of ``spread``. Only keys with more than ``limit`` facts are
    salted; there are at most ``facts / limit`` of them, which is what bounds the broadcast of their names.
    All other keys join as they are. ``parts``: into how many parts both sides are dealt out.
    """
    heavy = F.col(weight) > limit
    hot = lookup.where(heavy).select(on, F.lit(True).alias("_hot"))
    salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    left = facts.join(F.broadcast(hot), on, "left").select(
        *facts.columns, F.when(F.col("_hot"), salt).otherwise(0).alias("_salt")
    )
    every = F.when(heavy, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = lookup.withColumn("_salt", F.explode(every))
    if parts:
        left, right = left.repartition(parts, on, "_salt"), right.repartition(parts, on, "_salt")
    return left.join(right, [on, "_salt"]).drop("_salt")


def left_join_many(parent: DataFrame, child: DataFrame, on: str) -> DataFrame:
    """Left join of one parent row to any number of child rows.

    An outer join cannot split its many-rows side, an inner join can (AQE skew join). So: inner
    join, plus the parents whose key is missing from the *distinct* child keys. Both parts read the
    children, so these are written once, whatever it took to make them.
    """
    child = stored(child, "children")
    missing = parent.join(child.select(on).distinct(), on, "left_anti")
    return parent.join(child, on).unionByName(missing, allowMissingColumns=True)


def with_position(
    df: DataFrame, order: Sequence[str], buckets: Sequence[Column], name: str = "position"
) -> DataFrame:
    """Zero-based position in the order of ``order``, without one global sort.

    ``buckets`` are expressions that cut the order into consecutive pieces, coarse ones first (the
    key divided by a width). Rows are numbered inside their piece. Sizes are summed up in two steps:
    the pieces of one coarse bucket among themselves, and the coarse buckets, of which there should
    be thousands rather than billions. The values depend on the data alone, so a task that is run
    again numbers its rows as before.
    """
    keys = [f"_b{i}" for i in range(len(buckets))]
    coarse, fine = keys[0], keys[1:]
    cut = df.withColumns(dict(zip(keys, buckets, strict=True)))
    sizes = cut.groupBy(*keys).agg(F.count("*").alias("_n"))

    def before(window: W.WindowSpec, size: str) -> Column:
        frame = window.rowsBetween(W.Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(size).over(frame), F.lit(0))

    tops = sizes.groupBy(coarse).agg(F.sum("_n").alias("_total"))
    tops = tops.select(coarse, before(W.Window.orderBy(coarse), "_total").alias("_start"))
    inner = before(W.Window.partitionBy(coarse).orderBy(*fine), "_n") if fine else F.lit(0)
    offsets = sizes.withColumn("_inner", inner).join(tops, coarse).select(
        *keys, (F.col("_start") + F.col("_inner")).alias("_before")
    )
    inside = W.Window.partitionBy(*keys).orderBy(*order)
    numbered = cut.withColumn("_i", F.row_number().over(inside) - 1)
    return (
        numbered.join(offsets, keys)
        .withColumn(name, (F.col("_before") + F.col("_i")).cast("bigint"))
        .drop(*keys, "_before", "_i")
    )
