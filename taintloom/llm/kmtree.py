"""Operator 6, approximate nearest neighbours by largest inner product: a hierarchical k-means tree with best-bin-first
traversal. The number of leaves that a query visits is widened until recall on calibration queries is reached.
"""

from __future__ import annotations

import functools
import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .rpforest import matrix, usable

#: Candidates and queries of one cell; a cell's scores are made in slices of SLICE queries.
CELL_CANDIDATES, CELL_QUERIES, SLICE = 4000, 2000, 250
#: Parts in which the lists of a query's cells are merged before the parts are.
MERGE_SHARES = 64


@dataclass
class Tree:
    """Inner nodes' children and all nodes' centroids; leaves are numbered in `leaf`, -1 of inner nodes."""

    centroids: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray

    @property
    def n_leaves(self) -> int:
        return int((self.leaf >= 0).sum())

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: from the root to the nearest child's centroid."""
        node = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.leaf[node] < 0)
            if not len(inner):
                return self.leaf[node]
            for parent in np.unique(node[inner]).tolist():
                at = inner[node[inner] == parent]
                kids = np.array(self.children[parent])
                c = self.centroids[kids]
                node[at] = kids[((c * c).sum(1) - 2 * x[at] @ c.T).argmin(1)]

    def visit(self, q: np.ndarray, most: int, held: np.ndarray | None = None, least: int = 0) -> list[int]:
        """Leaves in best-bin-first order, by a priority queue of nodes by the inner product of query and centroid: `most`
        of them, and more until they hold `least` candidates (`held`: those of each leaf) or there are none left."""
        score = self.centroids @ q
        queue, out, n = [(0.0, 0)], [], 0
        while queue and (len(out) < most or n < least):
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                out.append(int(self.leaf[node]))
                n += least if held is None else int(held[self.leaf[node]])
            for kid in self.children[node]:
                heapq.heappush(queue, (-float(score[kid]), kid))
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        sums, n = np.zeros_like(c), np.bincount(own, minlength=k)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return ((c * c).sum(1) - 2 * x @ c.T).argmin(1)


def grow(x: np.ndarray, leaves: int, branch: int = 8, seed: int = 23) -> Tree:
    """A tree of about `leaves` leaves over the sample x."""
    rng = np.random.default_rng(seed)
    size = max(8, math.ceil(len(x) / max(1, leaves)))
    centroids, children, leaf, n_leaves = [], [], [], 0
    todo = [(x, -1)]
    while todo:
        part, parent = todo.pop(0)
        node = len(centroids)
        centroids.append(part.mean(0))
        children.append([])
        leaf.append(-1)
        if parent >= 0:
            children[parent].append(node)
        own = _kmeans(part, min(branch, math.ceil(len(part) / size)), rng) if len(part) > size else None
        if own is None or len(np.unique(own)) < 2:
            leaf[node] = n_leaves
            n_leaves += 1
        else:
            todo += [(part[own == k], node) for k in np.unique(own)]
    return Tree(np.array(centroids), children, np.array(leaf))


def calibrate(tree: Tree, x: np.ndarray, top: int, recall: float, queries: int = 200, seed: int = 29) -> tuple[int, float]:
    """(visits, recall): the fewest leaves to visit, in steps of a tenth, so that calibration queries out of the sample
    find that share of their true nearest ones in the sample."""
    q = np.random.default_rng(seed).choice(len(x), min(queries, len(x)), replace=False)
    at = tree.assign(x)
    score = x[q] @ x.T
    score[np.arange(len(q)), q] = -np.inf
    k = min(top, len(x) - 1)
    if k < 1:
        return tree.n_leaves, 1.0
    true = np.argpartition(-score, k - 1, axis=1)[:, :k]
    rank = np.empty((len(q), tree.n_leaves), np.int64)
    for i, row in enumerate(q.tolist()):
        rank[i, tree.visit(x[row], tree.n_leaves)] = np.arange(tree.n_leaves)
    need = np.take_along_axis(rank, at[true], 1)
    visits = 1
    while (got := float((need < visits).mean())) < recall and visits < tree.n_leaves:
        visits = min(tree.n_leaves, max(visits + 1, math.ceil(visits * 1.1)))
    return visits, got


#: So many lengths of vectors are searched, each by itself.
MOST_WIDTHS = 64


def nearest(rows: DataFrame, queries, top: int = 20, recall: float = 0.96, most_leaves: int = 2048, sample_rows: int = 20_000, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` rows with the largest inner product for each row that the condition
    `queries` picks, the row itself aside; ties go to the smaller key.

    Vectors of one length make an index: an inner product needs equal lengths, so queries find rows of theirs only. More
    than MOST_WIDTHS lengths are an error. Unusable vectors (null, empty, zero, or with null or non-finite numbers) and
    null keys take no part; rows that repeat a key and a vector count once; an empty table gives an empty result; extra
    columns are not read.
    """
    good = rows.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("asks"), F.xxhash64(F.lit(1), vector).alias("h1"), F.xxhash64(F.lit(2), vector).alias("h2"), F.col(vector).cast("array<double>").alias("vector"))
    good = good.dropDuplicates(["id", "h1", "h2"])
    order = Window.partitionBy("h1", "h2").orderBy("id")
    first = good.select("h1", "h2", "id", "vector").withColumn("n", F.row_number().over(order)).where(F.col("n") <= top + 1)
    points = cut(first.groupBy("h1", "h2").agg(F.min("id").alias("node"), F.array_sort(F.collect_list("id")).alias("ids"), F.first("vector").alias("vector")))
    asking = cut(good.where("asks").select("id", "h1", "h2").join(points.select("h1", "h2", "node"), ["h1", "h2"]).select("id", "node"))
    widths = sorted(r[0] for r in points.select(F.size("vector")).distinct().limit(MOST_WIDTHS + 1).collect())
    if len(widths) > MOST_WIDTHS:
        raise ValueError(f"vectors have more than {MOST_WIDTHS} lengths")
    if not widths:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = [_search(points.where(F.size("vector") == w), asking, top, recall, most_leaves, sample_rows) for w in widths]
    return functools.reduce(DataFrame.unionByName, found)


def _search(points: DataFrame, asking: DataFrame, top: int, recall: float, most_leaves: int, sample_rows: int) -> DataFrame:
    """The result for points (node, ids, vector) of one length and the rows (id, node) that ask.

    The tree has leaves in proportion to the square root of the number of vectors, so that leaves and the number of them
    that a query visits grow evenly. It is grown and calibrated on a bounded sample (`sample_rows`, the first by a hash of the key); every vector is
    indexed. Equal vectors are one candidate with their `top` + 1 smallest keys and one query: since ties go to smaller
    keys no other copy can be in a result, so this loses nothing and copies of a hot vector cost one search. Leaves of
    any size are scored in cells of bounded blocks. A query visits the calibrated number of leaves, and more where these
    hold too few candidates. Scores are products in double precision summed the same way for every pair.
    """
    most = top + 1
    sample = points.orderBy(F.xxhash64(F.lit(5), "node")).limit(sample_rows).select("vector").toArrow().column(0)
    x = matrix(sample)
    tree = grow(x, min(most_leaves, math.ceil(math.sqrt(points.count()) / 4)))
    visits, _ = calibrate(tree, x, top, recall)

    def to_leaf(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(tree.assign(matrix(b.column(2)))), *b.columns], names=["leaf", "node", "ids", "vector"])

    candidates = cut(points.select("node", "ids", "vector").mapInArrow(to_leaf, "leaf long, node long, ids array<long>, vector array<double>"))
    # One row per leaf of the tree, which has a bounded number of them.
    sizes = candidates.groupBy("leaf").agg(F.sum(F.size("ids")).alias("ids"), F.ceil(F.count("*") / CELL_CANDIDATES).cast("int").alias("c"))
    held = np.zeros(tree.n_leaves, np.int64)
    for r in sizes.collect():
        held[r["leaf"]] = r["ids"]

    def to_visits(batches):
        for b in batches:
            q = matrix(b.column(1))
            found = [tree.visit(v, visits, held, most) for v in q]
            part = b.take(pa.array(np.repeat(np.arange(len(q)), [len(f) for f in found])))
            yield pa.RecordBatch.from_arrays([pa.array([k for f in found for k in f], pa.int64()), *part.columns], names=["leaf", "node", "vector"])

    searches = points.join(asking.select("node").distinct(), "node", "left_semi").select("node", "vector").mapInArrow(to_visits, "leaf long, node long, vector array<double>")
    blocks = sizes.drop("ids").join(searches.groupBy("leaf").agg(F.ceil(F.count("*") / CELL_QUERIES).cast("int").alias("q")), "leaf")
    blocks = F.broadcast(cut(blocks))
    own = F.xxhash64("node")
    cand = candidates.join(blocks, "leaf").withColumn("ci", F.pmod(own, "c").cast("int")).withColumn("qi", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    ask = searches.join(blocks, "leaf").withColumn("qi", F.pmod(own, "q").cast("int")).withColumn("ci", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))

    def score(left, right):
        node, ids = left["node"].to_numpy(), right["ids"].to_pylist()
        if not len(node) or not ids:
            return pa.table({"node": pa.array([], pa.int64()), "leaf": pa.array([], pa.int64()), "ci": pa.array([], pa.int32()), "found": pa.array([], found)})
        q, c = matrix(left["vector"]), matrix(right["vector"])
        out = []
        for at in range(0, len(q), SLICE):
            rough = q[at : at + SLICE] @ c.T
            k = min(most, len(c))
            border = np.partition(rough, len(c) - k, axis=1)[:, len(c) - k]
            slack = 1e-9 * (1 + np.abs(border))
            for i in range(len(rough)):
                near = np.flatnonzero(rough[i] >= border[i] - slack[i])
                exact = (c[near] * q[at + i]).sum(1)
                full = sorted((-s, v) for s, j in zip(exact.tolist(), near.tolist(), strict=True) for v in ids[j])[:most]
                out.append([{"s": s, "v": v} for s, v in full])
        return pa.table({"node": pa.array(node), "leaf": left["leaf"].cast(pa.int64()), "ci": left["ci"].cast(pa.int32()), "found": pa.array(out, found)})

    found = pa.list_(pa.struct([("s", pa.float64()), ("v", pa.int64())]))
    scored = ask.select("leaf", "ci", "qi", "node", "vector").groupBy("leaf", "ci", "qi").cogroup(cand.select("leaf", "ci", "qi", "node", "ids", "vector").groupBy("leaf", "ci", "qi")).applyInArrow(score, "node long, leaf long, ci int, found array<struct<s:double,v:long>>")
    # A query's lists are cut to their best in two steps, so that no row holds more than a share of its cells' lists.
    best = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, most).alias("found")
    shares = scored.groupBy("node", F.pmod(F.xxhash64("leaf", "ci"), F.lit(MERGE_SHARES)).alias("share")).agg(best)
    lists = cut(shares.groupBy("node").agg(best))
    each = asking.join(lists, "node").select("id", F.slice(F.filter("found", lambda f: f["v"] != F.col("id")), 1, top).alias("found"))
    return each.select(F.col("id").alias("query_id"), F.posexplode("found").alias("p", "f")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("f.v").alias("vec_id"), (-F.col("f.s")).alias("score"))
