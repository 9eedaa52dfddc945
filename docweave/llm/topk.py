"""Exact top-k by inner product: distributed histograms narrow down each query's k-th score.

Vectors are quantised to integers; queries and candidates are cut into blocks, and a cell is one block
of each. Every pass scores all cells. First each query's scores are counted in wide ranges, and the one
that holds its k-th highest score is found from the sums over all cells; it is counted again in narrower
ranges until one score is left. The last pass keeps what lies above that score, and of the vectors that
have just that score those with the smallest ids. Nothing is sampled, and the state of a query between
passes is one row, whatever the number of candidates.

Vectors that are null, empty or hold null or non-finite components take no part, neither as a query nor
as a candidate; rows with a null id neither. Vectors of unequal length are filled up with zeros. Rows
that share an id: each is a candidate, for other ids; as a query the id has the one that sorts first.
Components are limited to 2**62, and scores to just
less than 2**63, on either side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.store import alone, drop, keep

QUERIES, CANDIDATES = 1024, 1024  # rows of a block
BINS = 128  # ranges a pass counts in
SCALE = 64
LIMIT = (1 << 63) - 4096  # scores beyond are limited to it


def _quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, v: floor(SCALE * x) of all usable vectors."""
    x = F.col("embedding")
    usable = F.coalesce(F.size(x) > 0, F.lit(False)) & F.col("vec_id").isNotNull()
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = alone(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long"), x.cast("array<double>").alias("embedding"))
    return rows.where(usable & fine).select("vec_id", F.transform("embedding", lambda c: F.floor(F.greatest(F.lit(-(2.0**62)), F.least(F.lit(2.0**62), c * F.lit(float(SCALE)))))).alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    flat = column.flatten().to_numpy()
    if len(sizes) and (sizes == sizes[0]).all():
        out[:, : sizes[0]] = flat.reshape(len(sizes), -1)
    else:
        row = np.repeat(np.arange(len(sizes)), sizes)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles while they are exact, then in Python's integers."""
    if not len(q) or not len(c):
        return np.zeros((len(q), len(c)), np.int64)
    high = float(np.abs(q.astype(np.float64)).max()) * float(np.abs(c.astype(np.float64)).max()) * q.shape[1]
    if high < 2.0**53:
        return np.rint(q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    exact = q.astype(object) @ c.T.astype(object)
    return np.clip(exact, -LIMIT, LIMIT).astype(np.int64)


class Search:
    """Cells of one search; the passes differ in what they do with a cell's scores."""

    def __init__(self, vectors: DataFrame, is_query: Column):
        rows = _quantised(vectors)
        self.kept = keep(rows.withColumn("is_query", F.coalesce(is_query, F.lit(False))), "vectors")
        size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        facts = self.kept.agg(
            F.count("*"), F.count_if("is_query"), F.max(F.size("v")), F.max(size), F.max(F.when(F.col("is_query"), size))
        ).first()
        self.n, n_queries, self.width = facts[0], facts[1], facts[2] or 0
        self.bound = min(LIMIT, int((facts[3] or 0.0) * (facts[4] or 0.0) * 1.0000001) + 1)  # no score lies beyond
        self.q_blocks, self.c_blocks = max(1, -(-n_queries // QUERIES)), max(1, -(-self.n // CANDIDATES))
        best = Window.partitionBy("vec_id").orderBy("v")
        first = self.kept.where("is_query").withColumn("n", F.row_number().over(best)).where("n = 1")
        self.queries = keep(
            first.select(F.pmod(F.xxhash64("vec_id"), F.lit(self.q_blocks)).cast("int").alias("q"), F.col("vec_id").alias("query_id"), "v"), "queries"
        )

    def cells(self, run, schema: str, state: DataFrame) -> DataFrame:
        """``run(queries, candidates)`` for each pair of blocks; ``state``: query_id, low, high, width, need."""
        n = F.sequence(F.lit(0), F.lit(self.c_blocks - 1))
        left = self.queries.join(state, "query_id").withColumn("c", F.explode(n))
        left = left.select("q", "c", F.col("query_id").alias("id"), "v", "low", "high", "width", "need", F.lit(True).alias("is_query"))
        no = F.lit(0).cast("long")
        c = F.pmod(F.xxhash64("vec_id", "v"), F.lit(self.c_blocks)).cast("int").alias("c")
        right = self.kept.select(c, F.col("vec_id").alias("id"), "v").withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(self.q_blocks - 1))))
        right = right.select("q", "c", "id", "v", no.alias("low"), no.alias("high"), no.alias("width"), no.alias("need"), F.lit(False).alias("is_query"))

        def cell(table: pa.Table) -> pa.Table:
            asked = table.filter(table["is_query"])
            return run(asked, table.filter(pa.compute.invert(table["is_query"])))

        return left.union(right).groupBy("q", "c").applyInArrow(cell, schema)


def _counter(width: int):
    """Counts of each query's scores by range; ranges that can't hold the k-th score any more are left out."""

    def run(asked: pa.Table, others: pa.Table) -> pa.Table:
        q, c = asked["id"].to_numpy(), others["id"].to_numpy()
        low, high, wide, need = (asked[x].to_numpy() for x in ("low", "high", "width", "need"))
        score = _scores(_matrix(asked["v"], width), _matrix(others["v"], width))
        # Below or above the ranges, or the query itself: counted nowhere.
        # Differences of signed numbers are right as unsigned ones, whatever their size.
        at = ((score.view(np.uint64) - low.view(np.uint64)[:, None]) // wide.view(np.uint64)[:, None]).astype(np.int64)
        at[score < low[:, None]] = -1
        at[score > high[:, None]] = BINS
        at[q[:, None] == c[None]] = -1
        flat = (at + 1) + np.arange(len(q))[:, None] * (BINS + 2)
        n = np.bincount(flat.ravel(), minlength=len(q) * (BINS + 2)).reshape(len(q), BINS + 2)[:, 1 : BINS + 1]
        above = np.cumsum(n[:, ::-1], axis=1)[:, ::-1] - n
        row, bin_ = np.nonzero((n > 0) & (above < need[:, None]))
        return pa.table({"query_id": q[row], "bin": bin_.astype(np.int32), "n": n[row, bin_]})

    return run


def _taker(width: int):
    """Scores above the k-th one, and of those equal to it as many as are needed, smallest ids first."""

    def run(asked: pa.Table, others: pa.Table) -> pa.Table:
        q, c = asked["id"].to_numpy(), others["id"].to_numpy()
        order = np.argsort(c, kind="stable")
        c = c[order]
        low, need = asked["low"].to_numpy(), asked["need"].to_numpy()
        score = _scores(_matrix(asked["v"], width), _matrix(others["v"], width)[order])
        other = q[:, None] != c[None]
        above = other & (score > low[:, None])
        equal = other & (score == low[:, None])
        equal &= np.cumsum(equal, axis=1) <= need[:, None]
        row, column = np.nonzero(above | equal)
        return pa.table({"query_id": q[row], "vec_id": c[column], "score": score[row, column]})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` highest scores of each query, ties to smaller ids.

    ``vectors``: vec_id, embedding. Candidates are all rows with another id. Fewer than ``k`` rows, if
    there are fewer candidates.
    """
    search = Search(vectors, is_query)
    low = -search.bound
    wide = max(1, -(-(2 * search.bound + 1) // BINS))
    first = {"low": low, "high": search.bound, "width": wide, "need": k}
    state = search.queries.select("query_id", *[F.lit(v).cast("long").alias(c) for c, v in first.items()])
    state = keep(state, "ranges")
    while True:
        counts = search.cells(_counter(search.width), "query_id long, bin int, n long", state).groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        so_far = counts.join(state, "query_id").withColumn("upto", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)))
        # The first range at which the need is met, or the lowest one where it never is.
        hit = so_far.withColumn("left", F.col("need") - (F.col("upto") - F.col("n")))
        hit = hit.where("left > 0").groupBy("query_id").agg(F.min_by(F.struct("bin", "left", "low", "high"), "bin").alias("x"))
        wide_of = F.lit(wide).cast("decimal(20,0)")  # sums may pass 64 bits before they are limited
        begin = F.col("x.low").cast("decimal(20,0)") + F.col("x.bin").cast("decimal(4,0)") * wide_of
        done, finer = wide == 1, max(1, -(-wide // BINS))
        new = hit.select(
            "query_id",
            begin.cast("long").alias("low"),
            F.least(F.col("x.high").cast("decimal(30,0)"), begin + wide_of - 1).cast("long").alias("high"),
            F.lit(finer).cast("long").alias("width"),
            F.col("x.left").alias("need"),
        )
        old, state, wide = state, keep(new, "ranges"), finer
        drop(old)
        if done:
            break
    hits = search.cells(_taker(search.width), "query_id long, vec_id long, score long", state)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
