"""Operator 1, embedding near-dedup by a random-projection tree forest.

Every tree splits the vectors by random directions at sampled medians; vectors near a split go both ways (spill). Pairs
are compared within leaves, those with enough cosine are verified in double precision and united, over many trees. How
many vectors each vector links with is then counted within the components, since no link leaves its component.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cells, cut, spread_join
from .components import components

#: Rows of a leaf's cell; with the vectors of two blocks a task holds a few MB.
CELL_ROWS = 1000


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def usable(vector: str):
    """A vector takes part if it is not null or empty, holds no null and only finite numbers, and isn't zero."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & ~bad & F.exists(x, lambda v: v != 0), F.lit(False))


def distinct_vectors(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(key, h1, h2) of usable rows, and (node, h1, h2, n, vector) of distinct vectors: node is the smallest key, n the
    number of rows. Equal vectors are summed map-side, so a vector that a third of the rows share is one row from here."""
    good = rows.where(usable(vector)).select(F.col(key).cast("long").alias("key"), F.xxhash64(F.lit(1), vector).alias("h1"), F.xxhash64(F.lit(2), vector).alias("h2"), F.col(vector).cast("array<double>").alias("vector"))
    points = good.groupBy("h1", "h2").agg(F.min("key").alias("node"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    return good.select("key", "h1", "h2"), points


#: Bytes that the forests of all vector lengths may have together; they are broadcast.
FOREST_BYTES = 64 << 20


@dataclass
class Tree:
    """`depth` levels of nodes with directions and (low, high) borders at the sample's quantiles: below high goes left, from
    low on right. Below them, levels that need no sample: one direction a level, with the border at the projection of the
    leaf's center and a margin of its radius, which is how far projections of the leaf scatter."""

    depth: int
    directions: np.ndarray
    borders: np.ndarray
    centers: np.ndarray
    margins: np.ndarray
    more: np.ndarray

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of unit vectors; a row that is near splits has several leaves."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            v = np.einsum("nd,nd->n", x[row], self.directions[node])
            left, right = v < self.borders[node, 1], v >= self.borders[node, 0]
            right |= ~left
            row, node = np.r_[row[left], row[right]], np.r_[2 * node[left] + 1, 2 * node[right] + 2]
        if not len(self.more):
            return row, node
        top = node - (2**self.depth - 1)
        here, middle = x @ self.more.T, self.centers @ self.more.T
        for k in range(len(self.more)):
            v, margin = here[row, k] - middle[top, k], self.margins[top]
            left, right = v < margin, v >= -margin
            right |= ~left
            row, top, node = np.r_[row[left], row[right]], np.r_[top[left], top[right]], np.r_[2 * node[left] + 1, 2 * node[right] + 2]
        return row, node


def grow(sample: np.ndarray, trees: int, depth: int, extra: int, spill: float, seed: int = 17) -> list[Tree]:
    """Trees of `depth` levels at the sample's medians and `extra` ones below."""
    rng = np.random.default_rng(seed)
    scatter = NormalDist().inv_cdf(0.5 + spill)
    out = []
    for _ in range(trees):
        directions = rng.standard_normal((2**depth - 1, sample.shape[1])).astype(np.float32)
        borders = np.zeros((2**depth - 1, 2))
        held = {0: sample}
        for node in range(2**depth - 1):
            x = held.pop(node, sample[:0])
            if len(x):
                v = x @ directions[node]
                low, mid, high = np.quantile(v, [0.5 - spill, 0.5, 0.5 + spill])
                borders[node] = low, high
                held[2 * node + 1], held[2 * node + 2] = x[v < mid], x[v >= mid]
        centers, margins = np.zeros((2**depth, sample.shape[1]), np.float32), np.zeros(2**depth)
        for k in range(2**depth):
            x = held.get(2**depth - 1 + k, sample[:0])
            if len(x):
                centers[k] = x.mean(0)
                margins[k] = scatter * np.sqrt(((x - centers[k]) ** 2).sum(1).mean())
        out.append(Tree(depth, directions, borders, centers, margins, rng.standard_normal((extra, sample.shape[1])).astype(np.float32)))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _forest(similar: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph over 0..n-1 that `similar(one, others)` tells the neighbours of."""
    free, out = np.arange(n), []
    while len(free):
        queue, free = [int(free[0])], free[1:]
        while queue and len(free):
            i = queue.pop()
            hit = similar(i, free)
            out += [(i, int(j)) for j in free[hit]]
            queue += free[hit].tolist()
            free = free[~hit]
    return out


def _meets(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    """Which of the unit vectors `a` and `b` have that cosine. The last bits of a product depend on the matrix that it is made
    in, so pairs at the border are summed by themselves, as anywhere else."""
    v = a @ b.T
    hit = v >= cosine
    i, j = np.nonzero(np.abs(v - cosine) < 1e-9)
    hit[i, j] = (a[i] * b[j]).sum(1) >= cosine
    return hit


def links(points: DataFrame, cosine: float, trees: int = 12, leaf: int = 256, spill: float = 0.04, sample_rows: int = 30_000, most_depth: int = 12) -> DataFrame:
    """(a, b): per leaf a spanning forest of the pairs (node, vector) with at least that cosine, linear in its rows.

    The upper levels of trees are grown on a bounded sample (`sample_rows`, the first by a hash of the node), at most
    `most_depth` of them and so many that FOREST_BYTES hold them; the levels below need none, so there are as many as
    bring leaves to about `leaf` rows at any number of vectors. Every vector is dealt to its leaves. A leaf with more
    rows than CELL_ROWS is compared in blocks, whatever its size.
    """
    n = points.count()
    spark = points.sparkSession
    if n < 2:
        return spark.createDataFrame([], "a long, b long")
    taken = points.orderBy(F.xxhash64(F.lit(5), "node")).limit(sample_rows).select("vector").toArrow().column(0)
    widths = pc.list_value_length(taken).to_numpy()
    depth = max(0, math.ceil(math.log2(n / leaf)))
    forests = {}
    for w, held in zip(*(x.tolist() for x in np.unique(widths, return_counts=True)), strict=True):
        share = FOREST_BYTES // len(np.unique(widths)) // (8 * trees * w)
        top = max(0, min(depth, most_depth, math.floor(math.log2(max(1, share))) - 1, math.floor(math.log2(held))))
        forests[w] = grow(_unit(matrix(taken.filter(pa.array(widths == w)))), trees, top, depth - top, spill)
    shared = spark.sparkContext.broadcast(forests)

    def deal(batches):
        forests = shared.value
        for b in batches:
            width = np.diff(b.column(1).offsets.to_numpy())
            for w in np.unique(width).tolist():
                part = b.filter(pa.array(width == w))
                x = _unit(matrix(part.column(1)))
                for t in range(trees):
                    row, at = forests[w][t].leaves(x) if w in forests else (np.arange(len(x)), np.zeros(len(x), np.int64))
                    part_t = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([pa.array((at << 32) | (w << 8) | t), *part_t.columns], names=["leaf", "node", "vector"])

    def compare(keys, t):
        node, x = t["node"].to_numpy(), _unit(matrix(t["vector"]))
        hit = _meets(x, x, cosine)  # a cell has some 2 * CELL_ROWS rows at most
        np.fill_diagonal(hit, False)
        some = np.flatnonzero(hit.any(1))
        edges = some[np.array(_forest(lambda i, free: hit[some[i], some[free]], len(some)), np.int64).reshape(-1, 2)]
        return pa.table({"a": node[edges[:, 0]], "b": node[edges[:, 1]]})

    dealt = points.select("node", "vector").mapInArrow(deal, "leaf long, node long, vector array<double>")
    keys = ["leaf", "cell_i", "cell_j"]
    dealt = cells(dealt, ["leaf"], ["node"], CELL_ROWS).select(*keys, "node", "vector").repartition(*keys)
    return dealt.groupBy(*keys).applyInArrow(compare, "a long, b long").distinct()


def link_counts(points: DataFrame, roots: DataFrame, cosine: float) -> DataFrame:
    """(node, near): how many rows other than copies link with each node of a component, exactly.

    Vectors within half the angle of the component's first vector link with each other without a comparison (the angle
    is a metric), so a dense group costs what its members outside that ball cost: those are compared with all members,
    in cells of blocks. A component with m members outside of n costs m * n products, so one that is a chain of very
    many vectors is dear; the README has figures. No component's members meet in one task.
    """
    half = math.cos(math.acos(cosine) / 2) + 1e-9
    members = cut(points.join(roots, "node").select("root", "node", "n", "vector"))
    total = members.count()
    middles = members.where("root = node").select("root", F.col("vector").alias("middle")).join(members.groupBy("root").count(), "root")

    def inside(batches):
        for b in batches:
            x, y = _unit(matrix(b.column(3))), _unit(matrix(b.column(4)))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array((x * y).sum(1) >= half)], names=["root", "node", "n", "vector", "inside"])

    paired = spread_join(members, middles, ["root"], "count", total, 2000).where(F.size("vector") == F.size("middle"))
    placed = cut(paired.select("root", "node", "n", "vector", "middle").mapInArrow(inside, "root long, node long, n long, vector array<double>, inside boolean"))
    sums = cut(placed.groupBy("root").agg(F.sum(F.when(F.col("inside"), F.col("n"))).alias("ball"), F.count("*").alias("all"), F.count_if(~F.col("inside")).alias("out")))
    by_ball = spread_join(placed.where("inside").select("root", "node", "n"), sums.select("root", "ball", "all"), ["root"], "all", total).select("node", (F.col("ball") - F.col("n")).alias("near"))
    shape = sums.where("out > 0").select("root", "all", F.ceil(F.col("out") / CELL_ROWS).cast("int").alias("u"), F.ceil(F.col("all") / CELL_ROWS).cast("int").alias("v"))
    open_roots = spread_join(placed, shape, ["root"], "all", total).withColumn("h", F.xxhash64("node"))
    left = open_roots.where(~F.col("inside")).withColumn("i", F.pmod("h", "u").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("v") - 1)))
    right = open_roots.withColumn("j", F.pmod("h", "v").cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("u") - 1)))
    both = left.select("root", "i", "j", "node", "n", "inside", "vector", F.lit(True).alias("left")).unionByName(right.select("root", "i", "j", "node", "n", "inside", "vector", F.lit(False).alias("left")))

    def compare(keys, t):
        side = t["left"].to_numpy()
        node, n, within, x = t["node"].to_numpy(), t["n"].to_numpy(), t["inside"].to_numpy(), _unit(matrix(t["vector"]))
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        hit = _meets(x[a], x[b], cosine)
        hit &= node[a][:, None] != node[b][None, :]
        back = hit & within[b][None, :]  # vectors in the ball get their links outside it from here
        near = np.r_[hit @ n[b], n[a] @ back]
        return pa.table({"node": np.r_[node[a], node[b]], "near": near.astype(np.int64)}).filter(pa.array(near > 0))

    across = both.repartition("root", "i", "j").groupBy("root", "i", "j").applyInArrow(compare, "node long, near long")
    return by_ball.unionByName(across).groupBy("node").agg(F.sum("near").alias("near"))


def near_vectors(rows: DataFrame, cosine: float = 0.9, key: str = "vec_id", vector: str = "embedding", **options) -> DataFrame:
    """One row per row of `rows`: (key, n_links, component_id, kept), vectors linked at a cosine of `cosine` or more.

    Vectors that are null, empty or zero or hold null or non-finite numbers link with nothing: no links, themselves as
    component, kept. Vectors of different lengths don't link. Equal vectors always link, and count once for each row;
    rows that repeat a key count as rows. A null key is kept out of minima, and its component may be null. An empty table
    gives an empty result; other columns are not read.
    """
    good, points = distinct_vectors(rows, key, vector)
    points = cut(points.where("node is not null"))
    edges = cut(links(points, cosine, **options))
    roots = cut(components(edges))
    near = link_counts(points, roots, cosine)
    facts = points.select("h1", "h2", "node", "n").join(roots, "node", "left").join(near, "node", "left")
    facts = facts.select("h1", "h2", F.coalesce("root", "node").alias("component"), (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    linked = good.join(facts, ["h1", "h2"], "left").select("key", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component", "key").alias("component_id"))
    alone = rows.where(~usable(vector)).select(F.col(key).cast("long").alias("key"), F.lit(0).cast("long").alias("n_links"), F.col(key).cast("long").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)).alias("kept"))
