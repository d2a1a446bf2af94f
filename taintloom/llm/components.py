"""Connected components of an edge table, by rounds of contraction; nothing but row counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut

#: A node that more than this share of a table's rows meet in is hot: there are fewer than 2 * HOT_NODES of them.
HOT_NODES = 1000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (columns a, b of one integer type): root is the smallest node that links
    reach. Nodes without an edge are absent. Self-loops, repeated and reversed edges are harmless, nulls are dropped;
    an empty table gives an empty result.

    A round orders nodes by a hash of its own, points every node at its first neighbour or itself, follows pointers four
    steps, and contracts: edges move to the nodes pointed at. In a random order less than half of the nodes are first among
    their neighbours and chains of pointers are short, whatever the graph's shape and the order of ids, so rounds grow with
    the logarithm of the number of nodes: a path of 100,000 nodes takes about 12. Tables shrink with the rounds; pointers
    are put together from the last, smallest one back, and a component's smallest node is found at the end.

    Minima are summed map-side, and a node with many edges (a hub) or many nodes pointing at it meets them where they lie:
    its pointer is broadcast, there being a bounded number of such nodes. Rounds are written to the shared folder and go
    once the result is checkpointed.
    """
    with Scratch(edges.sparkSession) as scratch:
        return cut(_components(edges, scratch))


def _components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    e = scratch.keep(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds = []
    while n := e.count():
        step = scratch.keep(_pointers(e, len(rounds)))
        for _ in range(2):
            step = scratch.keep(_follow(step, "root", step, step.where(F.col("degree") > n / HOT_NODES)))
        rounds.append(step.select("node", "root"))
        hot = step.where(F.col("degree") > n / HOT_NODES)
        ends = _follow(_follow(e, "a", step, hot), "b", step, hot)
        e = scratch.keep(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if not rounds:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = rounds.pop()
    while rounds:
        step = rounds.pop()
        shared = step.groupBy("root").count().where(F.col("count") > step.count() / HOT_NODES).select(F.col("root").alias("node"))
        labels = scratch.keep(_follow(step, "root", labels, labels.join(F.broadcast(shared), "node", "left_semi")))
    first = scratch.keep(labels.groupBy("root").agg(F.min("node").alias("first"), F.count("*").alias("n")))
    first = first.select(F.col("root").alias("node"), F.col("first").alias("root"), "n")
    return _follow(labels, "root", first, first.where(F.col("n") > labels.count() / HOT_NODES))


def _pointers(e: DataFrame, k: int) -> DataFrame:
    """(node, root, degree): every node with its first neighbour in the order of round k, or itself. Nodes of equal hashes
    (a tie) don't point at each other, so no pointers make a ring; the next round orders them otherwise."""
    place = lambda c: F.xxhash64(F.lit(k), c)
    ends = e.select(F.col("a").alias("node"), F.col("b").alias("to")).union(e.select("b", "a"))
    least = ends.groupBy("node").agg(F.min_by("to", place("to")).alias("to"), F.min(place("to")).alias("at"), F.count("*").alias("degree"))
    return least.select("node", F.when(F.col("at") < place("node"), F.col("to")).otherwise(F.col("node")).alias("root"), "degree")


def _follow(rows: DataFrame, key: str, pointers: DataFrame, hot: DataFrame) -> DataFrame:
    """`rows` with `key` replaced by what it points at in `pointers` (node, root), which has each node once; what isn't there
    stays. Rows of the few `hot` nodes are spread over the tasks by a hash instead of meeting in one."""
    near = F.broadcast(hot.select(F.col("node").alias("__hot"), F.col("root").alias("__near")))
    far = pointers.select(F.col("node").alias("__node"), F.col("root").alias("__far"))
    met = rows.join(near, F.col(key) == F.col("__hot"), "left")
    met = met.withColumn("__key", F.when(F.col("__near").isNull(), F.col(key)).otherwise(F.xxhash64(*rows.columns)))
    met = met.join(far, F.col("__key") == F.col("__node"), "left")
    return met.select(*(F.coalesce("__near", "__far", key).alias(c) if c == key else F.col(c) for c in rows.columns))
