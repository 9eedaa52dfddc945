"""Near-duplicate groups: LSH forest for candidates, full shingle sets for confirmation.

1. Every text becomes its set of word shingles (hashed to 64 bits) and a MinHash signature. Equal sets
   are one node from here on.
2. The forest has several trees, each with an order of the signature's places of its own. For every tree
   the signatures are sorted in that order (range partitions over all trees), so that those with the
   longest common prefixes are neighbours. Neighbours that share ``DEPTH`` places form a region. One that
   is small enough is a block; in a larger one the depth is raised until its parts fit, neighbours staying
   together; a text alone at that depth goes one place up. All of a block are compared by signature; a
   star joins those that may be similar. Regions too large for a block, or at the border of a partition,
   of which not all ended up in one cluster are looked through again, the smaller clusters against
   everything, in cells of bounded size.
3. A cluster of possibly similar texts is confirmed on full sets, again in cells of bounded size: first
   cuts of it, then what is outside the largest group against the whole cluster.

A pair above the threshold is lost only if no tree puts both into one region (for a similarity of 0.85
once in 10^7 pairs, for 0.8 once in 10^5) or if its signature is off by four standard deviations. No
pair is left out for want of room, and the pairs of a group are never written out. Ties in a sorted order
go by the node's number; where partitions and blocks begin has no influence on which pairs are compared
in the end. Very long texts are worked on in runs of shingles, a row of the forest has a fixed size.

Null and empty texts have empty sets: they are linked with nothing, not even each other. Rows that share
a doc_id count as one document. An empty table gives an empty result; other columns of the input are left
out, whatever their names. A null doc_id is no document: its row gets no component and isn't kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm import graph
from docweave.llm import words as W
from docweave.llm.store import alone, drop, keep

TREES, DEPTH = 24, 4
PLACES = TREES * DEPTH
BLOCK = 256  # texts compared with each other at a time
MEMBERS = 1024  # texts that smaller clusters of a region are compared with at a time
SHINGLES = 1 << 20  # and as many shingles at most, on the average, in a cell
_FACTORS = W.stream(23, PLACES) | np.uint64(1)
LONG = 15  # places of a tree's order that are sorted by; a byte for the tree comes before them
WALKED = 1 << 16  # sorted rows that a task holds at a time
_SECOND = np.uint64(0x5851F42D4C957F2D)


def cut(percent: int) -> float:
    """Share of equal signature places from which on a pair may reach the threshold: four deviations less."""
    p = percent / 100
    return p - 4 * (p * (1 - p) / PLACES) ** 0.5


def _distinct(texts: W.Texts, size: int) -> list[np.ndarray]:
    texts.words()
    all_of, bounds = W.windows(texts, size, lower=True, whole_if_short=True)
    return [W.distinct(all_of[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _node(shingles: np.ndarray) -> int:
    """64-bit hash of a set, as a signed number."""
    total = W.mix(shingles + _SECOND).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(W.mix(np.array([total])).view(np.int64)[0])


def _signed(sets: list[np.ndarray]) -> np.ndarray:
    """Signatures (32 bits a place) of non-empty sets."""
    out = np.empty((len(sets), PLACES), np.uint32)
    if not sets:
        return out
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    rows = 0
    while rows < len(sets):  # few enough shingles at a time for the processor's cache
        end = max(rows + 1, int(np.searchsorted(starts, starts[rows] + 32_768, "right")) - 1)
        part, at = flat[starts[rows] : starts[end]], starts[rows:end] - starts[rows]
        for k in range(PLACES):
            out[rows:end, k] = np.minimum.reduceat(((part * _FACTORS[k]) >> np.uint64(32)).astype(np.uint32), at)
        rows = end
    return out


def signatures(documents: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, node (null for an empty set), signature (a byte a place)."""

    def run(batches):
        for batch in batches:
            for texts in W.slices(batch.column("text")):
                sets = _distinct(texts, size)
                full = [i for i, s in enumerate(sets) if len(s)]
                signed = _signed([sets[i] for i in full])
                node = [None] * len(sets)
                sign: list = [None] * len(sets)
                for row, i in enumerate(full):
                    node[i] = _node(sets[i])
                    sign[i] = signed[row].astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(texts.first, texts.n),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(node, pa.int64()),
                        pa.array(sign, pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "node", "signature"],
                )

    schema = "doc_id long, n_shingles long, node long, signature binary"
    rows = alone(documents, "doc_id", "text")
    return rows.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of equal ``key`` from sorted rows; memory holds a batch and one run."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        keys = table[key].to_numpy()
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1]))
        if held and (last or held[-1][key][-1].as_py() != keys[0]):
            first = int(np.searchsorted(keys, keys[0], "right")) if held[-1][key][-1].as_py() == keys[0] else 0
            yield pa.concat_tables([*held, table.slice(0, max(first, last))])
            held, table = [], table.slice(max(first, last))
        elif last:
            yield table.slice(0, last)
            table = table.slice(last)
        if len(table):
            held.append(table)
    if held:
        yield pa.concat_tables(held)


def _groups(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    at = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
    yield from zip(at[:-1].tolist(), at[1:].tolist())


def _stars(near: np.ndarray) -> np.ndarray:
    """Component (smallest row) of each row of a symmetric matrix of links."""
    label = np.full(len(near), -1)
    for i in range(len(near)):
        if label[i] < 0:
            front = near[i].copy()
            reached = front.copy()
            reached[i] = True
            while front.any():
                new = near[front].any(0) & ~reached
                reached |= new
                front = new
            label[reached & (label < 0)] = i
    return label


def _edges(batches, key: str, compare) -> Iterator[pa.RecordBatch]:
    """``compare`` gives the links (two rows of node ids) of one group."""
    for table in _runs(batches, key):
        got = [compare(table.slice(a, b - a)) for a, b in _groups(table[key].to_numpy())]
        got = [g for g in got if g is not None]
        if got:
            a, b = np.concatenate(got, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _bytes(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _compare(left: np.ndarray, right: np.ndarray, least: float) -> np.ndarray:
    """Which pairs agree on enough places; chance agreement of a byte is taken off."""
    need = least + (1 - least) / 256
    out = np.empty((len(left), len(right)), bool)
    for i, row in enumerate(left):
        out[i] = (right == row).sum(1) >= need * PLACES
    return out


def _address(keys: np.ndarray, places: int) -> np.ndarray:
    """64-bit address of the trie's node that each key (tree and places) passes at a depth."""
    halves = np.where(np.arange(LONG + 1) <= places, keys, 0).astype(np.uint8).view(np.uint64)
    return W.mix(halves[:, 0] ^ W.mix(halves[:, 1] + np.uint64(places + 1)))


def _cut(common: np.ndarray, first: int, end: int, places: int, block: int) -> list[int]:
    """Where parts of a sorted run begin that agree on more than ``places`` places, or still fit a block.

    ``common[i]``: places that row i shares with the row before.
    """
    if end - first <= block:
        return [first]
    if places >= LONG:
        return list(range(first, end, block))
    starts = [first, *(first + 1 + np.flatnonzero(common[first + 1 : end] <= places)).tolist()]
    out = []
    for a, b in zip(starts, [*starts[1:], end]):
        parts = _cut(common, a, b, places + 1, block)
        # Neighbours fill up a block together.
        if len(parts) > 1 or not out or b - out[-1] > block:
            out += parts
    return out


def _regions(keys: np.ndarray, node: np.ndarray, left: bool, right: bool, block: int) -> Iterator[tuple]:
    """Regions of sorted keys, as arrays: region, block, node, open.

    ``left``, ``right``: whether the first and last region may go on outside. Open regions are those,
    and all that are too large for a block.
    """
    differ = keys[1:] != keys[:-1]
    same = np.where(differ.any(1), differ.argmax(1), LONG + 1) - 1
    common = np.concatenate([[-1], same])

    def runs(places: int):
        starts = np.flatnonzero(common < places)
        size = np.diff(np.append(starts, len(keys)))
        border = np.zeros(len(starts), bool)
        border[0] |= left
        border[-1] |= right
        return starts, size, border

    starts, size, border = runs(DEPTH)
    large = size > block
    taken = np.repeat(((size > 1) & ~large) | (border & ~large), size)
    region = _address(keys, DEPTH)
    yield region[taken], region[taken], node[taken], np.repeat(border, size)[taken]
    for a, n in zip(starts[large].tolist(), size[large].tolist()):
        parts = np.array(_cut(common, a, a + n, DEPTH, block))
        name = W.mix(_address(keys[parts], LONG) ^ node[parts].view(np.uint64))
        yield region[a : a + n], np.repeat(name, np.diff(np.append(parts, a + n))), node[a : a + n], np.ones(n, bool)
    single = np.repeat(size == 1, size)
    starts, size, border = runs(DEPTH - 1)
    up = np.repeat((((size > 1) & np.logical_or.reduceat(single, starts)) | border) & (size <= block), size)
    above = _address(keys[up], DEPTH - 1)
    yield above, above, node[up], np.zeros(int(up.sum()), bool)


def _walk(batches: Iterator[pa.RecordBatch], most: int, walked: int) -> Iterator[pa.RecordBatch]:
    """Regions of a partition of sorted rows (key, node); memory holds ``walked`` rows and a batch."""

    def told(keys, node, left, right):
        got = list(_regions(keys, node, left, right, most))
        region, block, node, open_ = (np.concatenate(x) for x in zip(*got))
        columns = [pa.array(region.view(np.int64)), pa.array(block.view(np.int64)), pa.array(node), pa.array(open_)]
        return pa.RecordBatch.from_arrays(columns, ["region", "block", "node", "open"])

    keys, node, left = np.zeros((0, LONG + 1), np.uint8), np.zeros(0, np.int64), True
    for batch in batches:
        keys = np.concatenate([keys, _bytes(batch.column("key"), LONG + 1)])
        node = np.concatenate([node, batch.column("node").to_numpy()])
        if len(node) >= walked:
            new = np.flatnonzero((keys[1:, :DEPTH] != keys[:-1, :DEPTH]).any(1))  # tree and DEPTH - 1 places
            end = int(new[-1]) + 1 if len(new) else len(node)
            yield told(keys[:end], node[:end], left, not len(new))
            keys, node, left = keys[end:], node[end:], not len(new)
    if len(node):
        yield told(keys, node, left, True)


def forest(signed: DataFrame) -> DataFrame:
    """region, block, node, open for the neighbours in each tree's order; ``signed``: node, signature."""
    turned = F.expr(f"substring(concat(signature, signature), {DEPTH} * tree + 1, {LONG})")
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    rows = signed.select("node", "signature", trees)
    rows = rows.select(F.concat(F.unhex(F.lpad(F.hex("tree"), 2, "0")), turned).alias("key"), "node")
    # The node is part of the order, so that many equal keys are spread as well.
    rows = rows.repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    most, walked = BLOCK, WALKED
    return rows.mapInArrow(lambda b: _walk(b, most, walked), "region long, block long, node long, open boolean")


def clusters(signed: DataFrame, percent: int) -> DataFrame:
    """node, cluster of all nodes that may be similar to another; ``signed``: node, signature."""
    least = cut(percent)
    rows = keep(forest(signed).join(signed.select("node", "signature"), "node"), "regions")
    blocks = rows.select("block", "node", "signature")
    hot = rows.where("open")

    def stars(table):
        if len(table) < 2:
            return None
        node, sign = table["node"].to_numpy(), _bytes(table["signature"], PLACES)
        to = _stars(_compare(sign, sign, least))
        moved = np.flatnonzero(to != np.arange(len(to)))
        return np.stack([node[moved], node[to[moved]]])

    blocks = blocks.repartition("block").sortWithinPartitions("block")
    found = keep(blocks.mapInArrow(lambda b: _edges(b, "block", stars), "a long, b long").distinct(), "stars")
    if found.isEmpty():
        drop(rows, found)
        return signed.sparkSession.createDataFrame([], "node long, cluster long")
    label = graph.components(found)
    open_ = hot.join(label, "node", "left").select("region", "node", "signature", F.coalesce("component", "node").alias("group"))
    crossing = _crossing(open_, "region", F.col("all") / MEMBERS)
    if crossing is not None:

        def across(table):
            new = table["new"].to_numpy(zero_copy_only=False)
            if new.all() or not new.any():
                return None
            node, group, sign = table["node"].to_numpy(), table["group"].to_numpy(), _bytes(table["signature"], PLACES)
            near = _compare(sign[new], sign[~new], least) & (group[new][:, None] != group[~new][None])
            left, right = np.nonzero(near)
            pairs = np.unique(np.stack([group[new][left], group[~new][right]]), axis=1)  # one link for two groups
            return pairs if pairs.size else None

        cells = crossing.repartition("cell").sortWithinPartitions("cell")
        more_found = keep(cells.mapInArrow(lambda b: _edges(b, "cell", across), "a long, b long").distinct(), "stars")
        drop(crossing)
        if not more_found.isEmpty():
            label = graph.components(found.union(more_found))
    drop(rows)
    return label.select("node", F.col("component").alias("cluster"))


def _crossing(rows: DataFrame, whole: str, blocks) -> DataFrame | None:
    """Cells in which all rows outside the largest ``group`` of each ``whole`` meet all its rows.

    ``blocks``: how many parts a whole is cut into on that side. None if there is nothing to do.
    """
    sizes = keep(rows.groupBy(whole, "group").agg(F.count("*").alias("k")), "sizes")
    several = sizes.groupBy(whole).agg(
        F.sum("k").alias("all"), F.max("k").alias("most"), F.count("*").alias("groups"), F.max(F.struct("k", "group")).alias("top")
    )
    several = keep(several.where("groups > 1").select(whole, "all", "most", F.col("top.group").alias("largest")), "several")
    drop(sizes)
    if several.isEmpty():
        drop(several)
        return None
    rows = rows.join(several, whole).withColumns(
        {"parts": F.ceil(blocks).cast("int"), "news": F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int")}
    )
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    old = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("news") - 1))).withColumn("j", part).withColumn("new", F.lit(False))
    new = (
        rows.where("group <> largest")
        .withColumn("i", F.pmod(F.xxhash64("node", F.lit(7)), F.col("news")))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("new", F.lit(True))
    )
    both = old.unionByName(new).withColumn("cell", F.xxhash64(whole, F.col("i").cast("int"), F.col("j").cast("int")))
    out = keep(both.drop("parts", "news", "i", "j", "largest", "all", "most"), "cells")
    drop(several)
    return out


def _similar(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets reach the threshold: sizes of all intersections by products of 0/1 matrices."""
    sizes = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    if len(left) * len(right) <= 16:
        common = np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in right] for a in left], np.float64)
    else:
        flat = np.concatenate([*left, *right])
        values, which, times = np.unique(flat, return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(left) + len(right)), np.concatenate(sizes))
        shared = times > 1
        column = np.cumsum(shared) - 1
        mine = shared[which]
        owner, column = owner[mine], column[which[mine]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((len(left), len(right)))
        width = 8192
        for low in range(0, int(shared.sum()), width):
            a, b = np.searchsorted(column, [low, low + width])
            there = np.zeros((len(left) + len(right), width), np.float32)
            there[owner[a:b], column[a:b] - low] = 1
            common += there[: len(left)] @ there[len(left) :].T
    union = sizes[0][:, None] + sizes[1][None] - common
    return 100 * common >= percent * union


def _sets(documents: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """``members`` (node, doc_id, cluster, cuts, n) with their shingles, as bytes."""

    def run(batches):
        for batch in batches:
            for texts in W.slices(batch.column("text")):
                part = batch.slice(texts.first, texts.n)
                sets = _distinct(texts, size)
                same = [len(s) > 0 and _node(s) == n for s, n in zip(sets, part.column("node").to_pylist())]
                columns = [part.column(c) for c in ("node", "cluster", "cuts")] + [pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "cluster", "cuts", "shingles"]).filter(pa.array(same))

    texts = alone(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # A shuffle at every size: members grow with the input, so a plan that broadcasts them when few says nothing.
    joined = texts.join(members.select("doc_id", "node", "cluster", "cuts").hint("merge"), "doc_id")
    out = joined.select("node", "cluster", "cuts", "text").mapInArrow(run, "node long, cluster long, cuts int, shingles binary")
    return out


def links(documents: DataFrame, nodes: DataFrame, cluster: DataFrame, size: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) that connect every group of similar nodes; ``nodes``: node, doc_id, n_shingles."""
    members = nodes.join(cluster, "node")
    per = members.groupBy("cluster").agg(F.count("*").alias("k"), F.sum("n_shingles").alias("total"))
    cuts = F.ceil(F.greatest(F.col("k") / BLOCK, F.col("total") / SHINGLES)).cast("int")
    members = keep(members.join(per.select("cluster", cuts.alias("cuts")), "cluster"), "members")
    sets = keep(_sets(documents, members, size), "sets")
    cell = F.xxhash64("cluster", F.pmod(F.xxhash64("node"), F.col("cuts")))

    def decoded(table):
        node, shingles = table["node"].to_numpy(), table["shingles"].to_pylist()
        keep_first = np.unique(node, return_index=True)[1]  # rows that share a doc_id and a text
        return node[keep_first], [np.frombuffer(shingles[i], np.uint64) for i in keep_first]

    def stars(table):
        if len(table) < 2:
            return None
        node, found = decoded(table)
        to = _stars(_similar(found, found, percent))
        moved = np.flatnonzero(to != np.arange(len(to)))
        return np.stack([node[moved], node[to[moved]]]) if len(moved) else None

    cells = sets.select(cell.alias("cell"), "node", "shingles").repartition("cell").sortWithinPartitions("cell")
    found = keep(cells.mapInArrow(lambda b: _edges(b, "cell", stars), "a long, b long"), "links")
    large = sets.where("cuts > 1")
    if not large.isEmpty():
        label = graph.components(found) if not found.isEmpty() else found.selectExpr("a AS node", "b AS component")
        large = large.join(label, "node", "left").select("cluster", "node", "cuts", F.coalesce("component", "node").alias("group"), "shingles")
        # Ids only while the cells are laid out; the sets join at the end.
        crossing = _crossing(large.drop("shingles"), "cluster", F.col("cuts"))
        if crossing is not None:

            def across(table):
                new = table["new"].to_numpy(zero_copy_only=False)
                if new.all() or not new.any():
                    return None
                group, node = table["group"].to_numpy(), table["node"].to_numpy()
                shingles = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
                of = lambda at: [shingles[i] for i in np.flatnonzero(at)]
                near = _similar(of(new), of(~new), percent) & (group[new][:, None] != group[~new][None])
                left, right = np.nonzero(near)
                pairs = np.stack([group[new][left], group[~new][right]])
                first = np.unique(pairs, axis=1, return_index=True)[1]  # one link for two groups
                return np.stack([node[new][left[first]], node[~new][right[first]]]) if len(first) else None

            cells = crossing.join(sets.select("node", "shingles").dropDuplicates(["node"]), "node")
            cells = cells.select("cell", "node", "group", "new", "shingles").repartition("cell").sortWithinPartitions("cell")
            more = keep(cells.mapInArrow(lambda b: _edges(b, "cell", across), "a long, b long"), "links")
            found = keep(found.union(more), "links")
            drop(crossing)
    drop(sets, members)
    return found


def groups(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links lead to), kept (doc_id = component_id).

    Documents are linked when their sets of ``size``-word shingles have a similarity of ``percent`` or more.
    """
    signed = keep(signatures(documents, size), "signatures")
    full = signed.where("node IS NOT NULL AND doc_id IS NOT NULL")
    nodes = full.groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")
    )
    nodes = keep(nodes, "nodes")
    cluster = clusters(nodes, percent)
    edges = links(documents, nodes.select("node", "doc_id", "n_shingles"), cluster, size, percent)
    # Rows that share an id are one document, whatever their texts.
    twice = full.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    edges = keep(edges.union(full.join(twice.select("doc_id", "a"), "doc_id").where("a <> node").select("a", F.col("node").alias("b"))), "links")
    if edges.isEmpty():
        label = edges.selectExpr("a AS node", "b AS component")
    else:
        label = graph.components(edges)
    least = nodes.join(label, "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    label = keep(label.join(least, "component").select("node", "component_id"), "components")
    own = nodes.select("node", F.col("doc_id").alias("own_id")).join(label, "node", "left")
    own = own.select("node", F.coalesce("component_id", "own_id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "node").join(own, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    )
