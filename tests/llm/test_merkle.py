"""The manifest against a tree that is built level by level in plain code."""

import hashlib
import random
import zlib

import duckdb
from pyspark.sql import functions as F

from taintloom.llm import merkle, queries

from .helpers import DOCS, awkward, none


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_leaf(r, more=0):
    values = (r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + more, r.text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        n = out[-1]
        out.append([sha("".join(n[k : k + 2])) for k in range(0, len(n), 2)])
    return out


def path(tree, pos):
    out = []
    for level in tree[:-1]:
        if pos ^ 1 < len(level):
            out.append(level[pos ^ 1])
        pos //= 2
    return out


def plain(rows):
    """Per language, in the order of leaves: (doc_id, leaf, subroot, root, proof)."""
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append(((r.doc_id is not None, r.doc_id or 0, plain_leaf(r)), r.doc_id))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([k[2] for k, _ in sorted(groups[g])]) for g in order}
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for i, g in enumerate(order):
        for pos, (k, doc_id) in enumerate(sorted(groups[g], key=lambda x: x[0])):
            out.append((doc_id, k[2], trees[g][-1][0], top[-1][0], sha("".join(path(trees[g], pos) + path(top, i)))))
    return out


def found(spark, df):
    rows = merkle.verified(merkle.manifest(df))
    out = rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "verified", "folded_root").collect()
    assert all(r.verified and r.folded_root == r.root for r in out)
    return [tuple(r)[:5] for r in out]


def key(rows):
    return sorted(rows, key=lambda r: tuple("" if v is None else str(v) for v in r))


def test_traversal_appends_siblings_for_every_size():
    for n in range(1, 40):
        nodes = [sha(str(k)) for k in range(n)]
        tree = levels(nodes)
        siblings = [[] for _ in nodes]
        assert merkle.traverse(nodes, (n - 1).bit_length(), siblings) == tree[-1][0]
        assert siblings == [path(tree, k) for k in range(n)]
        assert all(merkle.fold(nodes[k], k, n, siblings[k]) == (tree[-1][0], len(siblings[k])) for k in range(n))


def test_manifest_over_several_rounds(spark, monkeypatch):
    """Blocks of 4 leaves, so languages of up to 150 rows take four rounds; one language has most rows."""
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 2)
    rng = random.Random(1)
    rows = [(i, f"text {i}", "hot", "s", i) for i in range(150)]
    rows += [(1000 + i, "t" * i, rng.choice(["a", "é", "z", None, "b"]), None, None) for i in range(61)]
    rows += [(5000, "one", "lone", "s", 1), (7, "text 7", "hot", "s", 7), (7, "text 7", "hot", "s", 7), (7, "other", "hot", "s", 7), (None, "x", "hot", "s", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert key(found(spark, df)) == key(plain(df.collect()))


def test_awkward_rows_single_rows_and_no_rows(spark):
    df = awkward(spark)
    assert key(found(spark, df)) == key(plain(df.collect()))
    one = df.where("doc_id = 2")
    leaf = plain_leaf(one.first())
    assert found(spark, one) == [(2, leaf, leaf, leaf, sha(""))]
    assert found(spark, none(spark)) == []
    assert none(spark).schema.simpleString() == spark.createDataFrame([], DOCS).schema.simpleString()


def test_the_query_equals_a_plain_tree_and_its_sql(spark, sf):
    rows = {r.doc_id: r for r in queries.op12_merkle_manifest(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert key(tuple(r)[:5] for r in rows.values()) == key(plain(docs))
    touched = {d.doc_id for d in docs if zlib.crc32(str(d.doc_id).encode()) % 7 == 0 and d.n_chars is not None}
    assert touched and {i for i, r in rows.items() if not r.verified} == touched
    for i in list(touched)[:3]:
        assert rows[i].folded_root != rows[i].root
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(con.sql(f"SELECT {', '.join(names)} FROM ({queries.MERKLE_SQL})").fetchall()) == sorted(tuple(r) for r in rows.values())


def test_tampered_rows_fold_to_the_root_of_the_tampered_tree(spark):
    """What a tampered leaf folds to is the root of a dataset in which that row alone is changed."""
    rows = [(i, f"t{i}", "ab"[i % 2], "s", i) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    changed = df.withColumn("n_chars", F.when(F.col("doc_id") == 3, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    other = {r.doc_id: r for r in merkle.manifest(changed).collect()}
    mine = merkle.manifest(df).withColumn("shown", F.when(F.col("doc_id") == 3, F.lit(other[3].leaf)).otherwise(F.col("leaf")))
    got = {r.doc_id: r for r in merkle.verified(mine, "shown").collect()}
    assert [i for i, r in got.items() if not r.verified] == [3] and got[3].folded_root == other[3].root


def test_values_beyond_bytes_and_range(spark):
    df = spark.createDataFrame([(2**63 - 1, "\U0001f600\x00", "x", "", 2**63 - 1), (-(2**63), "", "", "-", -1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert key(found(spark, df)) == key(plain(df.collect()))
