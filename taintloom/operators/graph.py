"""Reachability over edge tables: breadth-first trees, bounded simple paths, node and mark folding."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_PATH = 20  # fixed value: a path has no more nodes than this


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in spark.checkpoint.dir. Only a local session may leave that unset, as in tests."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "taintloom-checkpoints"))
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries in the block go when those end. Else they stay until the driver happens to collect its
    garbage, and rounds of a long search pile them up."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame) -> DataFrame:
    """Rows kept as a compressed table beside the checkpoints, of which readers take the columns that they need. What was
    shuffled for them isn't kept."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        cut(df.sparkSession.range(0))
    path = f"{sc._jsc.sc().getCheckpointDir().get()}/rows-{uuid.uuid4().hex}"
    with tidied(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upsert_nodes(rows: DataFrame) -> DataFrame:
    """One node per (project_id, name): flags OR-ed, sanitized types united, the first origin that isn't null, the last
    snippet and line that aren't empty; by `seq`."""
    last = lambda c, empty: F.max_by(F.col(c), F.when(F.col(c).isNotNull() & (F.col(c) != F.lit(empty)), F.col("seq")))
    return rows.groupBy("project_id", "name").agg(
        F.bool_or("is_source").alias("is_source"),
        F.bool_or("is_sink").alias("is_sink"),
        F.bool_or("tainted").alias("tainted"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("sanitized_types")))).alias("sanitized_types"),
        F.min_by("origin", F.when(F.col("origin").isNotNull(), F.col("seq"))).alias("origin"),
        last("snippet", "").alias("snippet"),
        last("line", 0).alias("line"),
    )


def last_marks(marks: DataFrame, key: list[str], value: list[str]) -> DataFrame:
    """Per key the values of the last mark by `seq`: what a later mark of a variable overwrites."""
    best = marks.groupBy(*key).agg(F.max_by(F.struct(*value), "seq").alias("__m"))
    return best.select(*key, "__m.*")


def part_edges(rows: DataFrame, key: str = "project_id") -> DataFrame:
    """Edges from every part of a concatenation (array `parts`) to its `result`, in the parts' order."""
    return rows.select(key, "seq", F.posexplode("parts").alias("pos", "src"), F.col("result").alias("dst"))


def argument_edges(rows: DataFrame, key: str = "project_id") -> DataFrame:
    """Edges from an argument to its function's parameter, named function::parameter."""
    return rows.select(key, "seq", F.col("argument").alias("src"), F.concat_ws("::", "function", "parameter").alias("dst"))


@contextlib.contextmanager
def near_table(edges: DataFrame, key: str = "project_id", ranked: bool = False, types: DataFrame | None = None) -> Iterator[DataFrame]:
    """Edges (key, seq, src, dst) dealt once by the node that they leave, as a table in buckets, so that the levels of
    `bfs_paths` don't shuffle them again; of parallel ones the first, which alone can win. The table goes with the block.

    ranked: an edge's place among those of its node, an int, stands for its `seq`, with `dst` behind that in order. Of two ways
    from a source the first edge that differs decides, and both leave the node that their equal parts end at, so no other edges
    need be compared. types (key, node, types, each node once): what nodes are cleaned for goes along with their edges."""
    spark = edges.sparkSession
    name = f"taintloom_near_{uuid.uuid4().hex}"
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = edges.select(F.col(key).alias("__of"), "src", "dst", F.col("seq").alias("__seq"))
    rows = rows.repartition(n, "__of", "src").groupBy("__of", "src", "dst").agg(F.min("__seq").alias("__seq"))
    if ranked:
        rows = rows.withColumn("__seq", F.row_number().over(Window.partitionBy("__of", "src").orderBy("__seq", "dst")))
    if types is not None:
        rows = rows.join(types.select(F.col(key).alias("__of"), F.col("node").alias("src"), F.col("types").alias("__types")), ["__of", "src"], "left")
    with tidied(spark):
        rows.write.bucketBy(n, "__of", "src").saveAsTable(name, format="parquet")
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def cleaned(types: Column, kind: Column) -> Column:
    """Is what is cleaned for some types (null: none) cleaned for one?"""
    return F.coalesce(F.array_contains(types, kind) | F.array_contains(types, "all"), F.lit(False))


def bfs_paths(edges: DataFrame, sources: DataFrame, most: int = MAX_PATH, key: str = "project_id", label: str | None = None) -> DataFrame:
    """(key, source, node, path, order, depth): the breadth-first tree of every source, first edges first, to `most` nodes.

    Level by level for graphs of any size: the frontier meets the edges, nodes that their source has seen go, and of
    several arrivals at a node the first wins. A queue takes nodes of one level in the order of the edges that led to
    them, from the source on, so arrivals compare by their lists of `seq`: the first is a minimum, summed map-side, and no
    window orders a level. One join with the edges and one with what has been seen per level; each level is
    stored by columns, compressed, and an empty one ends the search. edges: key, seq (any type with an order, no two alike), src,
    dst. sources: key, source.

    edges may be a `near_table`, which many sources and levels share. With types, the result has `types` too, the united types
    of a path's nodes but its last, whose edges aren't taken.

    label: sources have a column `label` too, a tree of its own each, and paths don't go on from nodes that the types of such
    a table clean for their label. They may end there: who asks knows what the last node is cleaned for.
    """
    labels = [label] if label else []
    of = [key, *labels, "source"]
    e = edges if "__seq" in edges.columns else edges.select(F.col(key).alias("__of"), "src", "dst", F.col("seq").alias("__seq"))
    carried = ["types"] if "__types" in e.columns and not label else []
    start = sources.select(*of).distinct()
    none = F.array().cast(f"array<{e.schema['__seq'].dataType.simpleString()}>")
    frontier = stored(start.select(*of, F.col("source").alias("node"), F.array("source").alias("path"), none.alias("order"), *(F.array().cast("array<string>").alias(c) for c in carried)))
    seen = frontier
    won = F.min(F.struct("order", "path", *carried)).alias("__w")
    for _ in range(most - 1):
        step = frontier.join(e, (F.col(key) == F.col("__of")) & (F.col("node") == F.col("src")))
        if label:
            step = step.where(~cleaned(F.col("__types"), F.col(label)))
        more = [F.when(F.col("__types").isNull(), F.col(c)).otherwise(F.array_union(c, "__types")).alias(c) for c in carried]
        step = step.select(*of, F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), F.concat("order", F.array("__seq")).alias("order"), *more)
        fresh = step.join(seen.select(*of, "node"), [*of, "node"], "left_anti")
        frontier = stored(fresh.groupBy(*of, "node").agg(won).select(*of, "node", *(f"__w.{c}" for c in ("path", "order", *carried))))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.select(*of, "node", "path", "order", *carried, F.size("path").alias("depth"))


def breadth_first(near: dict[str, list[str]], source: str, most: int, blocked: set[str] | frozenset[str] = frozenset()) -> dict[str, str | None]:
    """Each node that is reached, in the order of arrival, with the node that it is reached from. Paths have `most` nodes at
    most and none of `blocked`."""
    tree: dict[str, str | None] = {source: None}
    level = [source]
    for _ in range(most - 1):
        level_next = []
        for node in level:
            for n in near.get(node, ()):
                if n not in tree and n not in blocked:
                    tree[n] = node
                    level_next.append(n)
        level = level_next
    return tree


def path_to(tree: dict[str, str | None], node: str) -> list[str]:
    out = []
    while node is not None:
        out.append(node)
        node = tree[node]
    return out[::-1]


def bfs_paths_grouped(edges: DataFrame, sources: DataFrame, most: int = MAX_PATH, key: str = "project_id") -> DataFrame:
    """The same for many graphs that each fit a task: one task per key, no rounds. The default for projects."""

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(right):
            k = right["of"].iloc[0]
            near: dict[str, list[str]] = {}
            for s, d in left.sort_values("seq")[["src", "dst"]].itertuples(index=False):
                near.setdefault(s, []).append(d)
            for source in right.sort_values("seq")["source"].drop_duplicates():
                tree = breadth_first(near, source, most)
                rows += [(k, source, node, path := path_to(tree, node), len(path)) for node in tree]
        return pd.DataFrame(rows, columns=[key, "source", "node", "path", "depth"])

    kind = edges.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, source string, node string, path array<string>, depth int"
    starts = sources.select(F.col(key).alias("of"), F.col("source").alias("source"), F.col("seq").alias("seq"))
    return edges.select(key, "src", "dst", "seq").groupBy(key).cogroup(starts.groupBy("of")).applyInPandas(search, schema)


def simple_paths(edges: DataFrame, source, target, most: int = MAX_PATH, src: str = "src", dst: str = "dst") -> DataFrame:
    """(path): every path from source to target that repeats no node, of at most `most` nodes; by a recursive query. Views
    have names of their own and go when the plan is made."""
    spark = edges.sparkSession
    name = f"taintloom_edges_{uuid.uuid4().hex}"
    edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct().createOrReplaceTempView(name)
    kind = edges.schema[src].dataType.simpleString()
    try:
        return spark.sql(
            f"""
            WITH RECURSIVE walk(node, path) AS (
              SELECT CAST(:a AS {kind}), array(CAST(:a AS {kind}))
              UNION ALL
              SELECT e.dst, array_append(w.path, e.dst) FROM walk w JOIN {name} e ON e.src = w.node
              WHERE size(w.path) < {int(most)} AND NOT array_contains(w.path, e.dst) AND w.node <> CAST(:b AS {kind})
            ) SELECT path FROM walk WHERE node = CAST(:b AS {kind})""",
            args={"a": source, "b": target},
        )
    finally:
        spark.catalog.dropTempView(name)
