"""Operator 12, a Merkle manifest of a dataset: a tree of digests per group, a tree over the groups' roots, and proofs.

Leaves are numbered within their group by a range sort. Aligned blocks of leaves are traversed recursively, each in one
task: a subtree returns its digest and, while the recursion unwinds, appends the sibling's digest to the leaves that it
contains. The blocks' roots are the leaves of the next, equally distributed traversal.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FEW, cut

#: A block has 2 ** BLOCK_LEVELS leaves at most, so a task's group is bounded whatever the size of a language.
BLOCK_LEVELS = 10


def digest(*parts: str) -> str:
    """Lowercase hexadecimal SHA-256 of the parts, concatenated; digests go in as hexadecimal text."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values: list[Column]) -> Column:
    """Digest of a row's values: each `-` if null, else its number of UTF-8 bytes, `:`, and itself (integers in decimal)."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """`rows` with `pos`, from 0 within each group by `order` (nulls first), and `n`, the group's number of rows.

    Rows are range-sorted over all tasks by group and order, so a group of any size is dealt over many of them; what lies
    before a task's part of a group is a sum over one row per task and group. Rows that tie in everything are told apart by
    where they lie, so they are dealt out too. `rows` should be a checkpoint: it is read twice, to sample and to sort.
    """
    rows = cut(rows.withColumn("__tie", F.monotonically_increasing_id()))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in (group, *order, "__tie")]
    at = F.monotonically_increasing_id()
    ordered = cut(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("__tie").withColumn("__task", F.shiftright(at, 33)).withColumn("__at", at.bitwiseAND(F.lit((1 << 33) - 1))))
    runs = ordered.groupBy(group, "__task").agg(F.count("*").alias("__rows"), F.min("__at").alias("__first"))
    whole = Window.partitionBy(group)
    before = F.sum("__rows").over(whole.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    runs = cut(runs.select(F.col(group).alias("__group"), F.col("__task").alias("__of"), "__first", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__rows").over(whole).alias("n")))
    few = runs.count() <= FEW  # a row per task and one per group: counted before it is broadcast
    found = ordered.join(F.broadcast(runs) if few else runs, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__task") == F.col("__of")))
    return found.withColumn("pos", F.col("__before") + F.col("__at") - F.col("__first")).drop("__task", "__at", "__group", "__of", "__first", "__before")


def traverse(nodes: list[str], levels: int, siblings: list[list[str]], low: int = 0) -> str:
    """Digest of the tree of `levels` levels over nodes[low:], in postorder. Each leaf below gets the digests of its
    siblings, lowest first: a subtree appends the other side's digest to the leaves that it contains while it unwinds."""
    if not levels:
        return nodes[low]
    half = 1 << (levels - 1)
    left = traverse(nodes, levels - 1, siblings, low)
    if low + half >= len(nodes):
        return digest(left)
    right = traverse(nodes, levels - 1, siblings, low + half)
    for k in range(low, low + half):
        siblings[k].append(right)
    for k in range(low + half, min(low + 2 * half, len(nodes))):
        siblings[k].append(left)
    return digest(left, right)


def _round(nodes: DataFrame, group: str, key: str) -> DataFrame:
    """One traversal: nodes (group, pos, n, node) as (group, pos, n, node, siblings, top), where siblings are those within the
    node's block and top is the block's root, on the block's first node only."""
    fields = nodes.schema[group].dataType.simpleString()

    def run(keys, t):
        t = t.sort_by("pos")
        n = t["n"][0].as_py()
        names = t["node"].to_pylist()
        siblings: list[list[str]] = [[] for _ in names]
        top = traverse(names, min(BLOCK_LEVELS, (n - 1).bit_length()), siblings)
        packed = pa.array([bytes.fromhex("".join(s)) for s in siblings], pa.binary())
        tops = pa.array([top] + [None] * (len(names) - 1), pa.string())
        return pa.table([t[group], t["pos"], t["n"], t[key], packed, tops], names=[group, "pos", "n", key, "siblings", "top"])

    block = F.shiftright("pos", BLOCK_LEVELS)
    kept = nodes.select(F.col(group), "pos", "n", key, "node").withColumn("block", block)
    kind = nodes.schema[key].dataType.simpleString()
    grouped = kept.groupBy(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")), "block")
    return cut(grouped.applyInArrow(run, f"`{group}` {fields}, pos long, n long, `{key}` {kind}, siblings binary, top string"))


def proofs(nodes: DataFrame, group: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(key, group, pos, n, siblings) of nodes (group, pos, n, key, node), and (group, node, n): the root of each group.

    siblings: the digests (32 bytes each) on the way to the root, lowest first; a level on which a node stands alone has
    none. As many rounds as the largest group's levels take, each over a 1,024th of the rows of the one before.
    """
    rounds = [_round(nodes, group, key)]
    while True:
        last = rounds[-1]
        tops = last.where("top is not null").select(group, F.shiftright("pos", BLOCK_LEVELS).alias("pos"), F.shiftright(F.col("n") + ((1 << BLOCK_LEVELS) - 1), BLOCK_LEVELS).alias("n"), F.col("top").alias("node"))
        if tops.where("n > 1").isEmpty():
            break
        rounds.append(_round(tops.withColumn("block_of", F.col("pos")), group, "block_of"))
    roots = tops.select(group, "node")
    above = None
    for r in reversed(rounds[1:]):
        above = _with_above(r, above, group).select(group, F.col("pos").alias("block"), "siblings")
        above = cut(above)
    return _with_above(rounds[0], above, group).select(key, group, "pos", "n", "siblings"), roots


def _with_above(nodes: DataFrame, above: DataFrame | None, group: str) -> DataFrame:
    """Appends to each node's siblings those of its block."""
    if above is None:
        return nodes
    up = above.select(F.col(group).alias("__group"), F.col("block").alias("__block"), F.col("siblings").alias("__above"))
    joined = nodes.join(up, F.col(group).eqNullSafe(F.col("__group")) & (F.shiftright("pos", BLOCK_LEVELS) == F.col("__block")), "left")
    return joined.withColumn("siblings", F.concat("siblings", F.coalesce("__above", F.lit(b"")))).drop("__group", "__block", "__above")


def fold(node: str, pos: int, n: int, siblings: list[str], at: int = 0) -> tuple[str, int]:
    """(root, siblings used) of a tree of n leaves from the one at `pos` and its siblings from `at` on."""
    while n > 1:
        if pos % 2:
            node = digest(siblings[at], node)
            at += 1
        elif pos + 1 < n:
            node = digest(node, siblings[at])
            at += 1
        else:
            node = digest(node)
        pos, n = pos // 2, (n + 1) // 2
    return node, at


def manifest(rows: DataFrame, values: list[str] | None = None, group: str = "lang", key: str = "doc_id", carried: dict[str, Column] | None = None) -> DataFrame:
    """Per row of `rows`: (key, leaf, subroot, root, pos, n, group_pos, groups, siblings, *carried).

    leaf: digest of the row's `values`. Per `group`, leaves stand in ascending order of `key` (null first; rows that repeat
    a key by their leaf) and every 2 consecutive nodes become their digest (a last one alone: its own) until one is left,
    the subroot; subroots, by group (null first, bytewise), give the root likewise. siblings: the digests (32 bytes each)
    that a leaf needs to fold to the root, lowest first; pos, n, group_pos, groups: its place and number of leaves in both
    trees. `carried`: more columns, kept with the rows. Equal rows have equal leaves and each a place of their own. A null
    value differs from an empty one. An empty table gives an empty result; other columns are not read.

    Texts are read once and go no further than their digests. No group of rows meets in one task: a sort deals them out,
    blocks have 1,024 leaves. The checkpoints survive the loss of executors.
    """
    values = values or ["doc_id", "source", "lang", "n_chars", "text"]
    carried = carried or {}
    own = rows.select(F.col(group).alias("g"), F.col(key).alias("k"), leaf([F.col(v) for v in values]).alias("node"), *(c.alias(f"c_{name}") for name, c in carried.items()))
    placed = numbered(own, "g", ["k", "node"]).withColumn("kept", F.struct("k", F.col("node").alias("leaf"), *(f"c_{name}" for name in carried)))
    in_group, roots = proofs(placed, "g", "kept")
    tops = numbered(roots.select(F.lit(0).alias("all"), F.col("g").alias("of"), "node"), "all", ["of"]).withColumn("kept", F.struct("of", F.col("node").alias("subroot")))
    over, root = proofs(tops, "all", "kept")
    over = over.select(F.col("kept.of").alias("of"), F.col("kept.subroot").alias("subroot"), F.col("pos").alias("group_pos"), F.col("n").alias("groups"), F.col("siblings").alias("upper"))
    over = cut(over.crossJoin(F.broadcast(root.select(F.col("node").alias("root")))))  # the root is one row
    few = over.count() <= FEW
    both = in_group.join(F.broadcast(over) if few else over, F.col("g").eqNullSafe(F.col("of")))
    return both.select(F.col("kept.k").alias(key), F.col("kept.leaf").alias("leaf"), "subroot", "root", "pos", "n", "group_pos", "groups", F.concat("siblings", "upper").alias("siblings"), *(F.col(f"kept.c_{name}").alias(name) for name in carried))


def verified(rows: DataFrame, leaf: str = "leaf") -> DataFrame:
    """Adds `proof_sha256` (of the siblings' digests as hexadecimal text), `folded_root` (from the column `leaf` and the
    siblings) and `verified` (the folded root is the root) to rows of `manifest`. A pass without a shuffle."""
    columns = rows.columns
    schema = rows.schema

    def run(batches):
        for b in batches:
            names = {c: b.column(k).to_pylist() for k, c in enumerate(columns) if c in (leaf, "pos", "n", "group_pos", "groups", "siblings", "root")}
            proof, folded = [], []
            for node, pos, n, g, groups, packed in zip(*(names[c] for c in (leaf, "pos", "n", "group_pos", "groups", "siblings")), strict=True):
                text = packed.hex()
                siblings = [text[i : i + 64] for i in range(0, len(text), 64)]
                subroot, used = fold(node, pos, n, siblings)
                proof.append(digest(text))
                folded.append(fold(subroot, g, groups, siblings, used)[0])
            same = [a == r for a, r in zip(folded, names["root"], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(proof, pa.string()), pa.array(folded, pa.string()), pa.array(same, pa.bool_())], names=[*columns, "proof_sha256", "folded_root", "verified"])

    out = functools.reduce(lambda s, f: s.add(*f), (("proof_sha256", "string"), ("folded_root", "string"), ("verified", "boolean")), type(schema)(list(schema.fields)))
    return rows.mapInArrow(run, out)
