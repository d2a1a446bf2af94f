"""Embedding near-dedup and nearest neighbours against brute force."""

import numpy as np
from pyspark.sql import functions as F

from taintloom.llm import kmtree, rpforest

from .helpers import united

SCHEMA = "vec_id long, embedding array<float>, label int, node string, leaf string"


def vectors(spark, seed=0, n=260):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 16))
    for i in range(0, n, 3):
        x[i] = x[i // 9] + 0.12 * rng.standard_normal(16)
    x[40:60] = x[40]
    x[100:140] = x[100] + 0.02 * rng.standard_normal((40, 16))
    x[7] *= 5
    rows = [(i, [float(v) for v in np.float32(r)], i % 3, "n", "l") for i, r in enumerate(x)]
    odd = [(1000, None, 1, None, None), (1001, [0.0] * 16, None, None, None), (1002, [1.0, None] + [0.0] * 14, 1, None, None), (1003, [float("nan")] + [1.0] * 15, 1, None, None), (1004, [float("inf")] + [1.0] * 15, 1, None, None), (1005, [], 1, None, None), (1006, [1.0, 2.0], 1, None, None)]
    return spark.createDataFrame(rows + odd, SCHEMA), {r[0]: np.array(r[1], float) for r in rows}


def test_near_vectors_equal_brute_force(spark):
    df, x = vectors(spark)
    ids = sorted(x)
    m = np.stack([x[i] / np.linalg.norm(x[i]) for i in ids])
    close = m @ m.T >= 0.9
    np.fill_diagonal(close, False)
    roots = united(len(ids), list(zip(*np.nonzero(np.triu(close)), strict=True)))
    rows = {r.vec_id: r for r in rpforest.near_vectors(df, 0.9, leaf=64).collect()}
    assert len(rows) == df.count()
    for k, i in enumerate(ids):
        assert rows[i].n_links == close[k].sum()
        assert rows[i].component_id == ids[roots[k]]
        assert rows[i].kept == (i == ids[roots[k]])
    for i in range(1000, 1007):
        assert (rows[i].n_links, rows[i].component_id, rows[i].kept) == (0, i, True)
    assert rpforest.near_vectors(df.limit(0)).count() == 0


def test_blocks_of_a_large_component(spark, monkeypatch):
    monkeypatch.setattr(rpforest, "CELL_ROWS", 25)
    df, x = vectors(spark, 3)
    rows = {r.vec_id: r.n_links for r in rpforest.near_vectors(df.where("vec_id < 1000"), 0.9, leaf=64).collect()}
    ids = sorted(x)
    m = np.stack([x[i] / np.linalg.norm(x[i]) for i in ids])
    assert [rows[i] for i in ids] == ((m @ m.T >= 0.9).sum(1) - 1).tolist()


def test_nearest_has_the_recall_and_exact_scores(spark):
    df, x = vectors(spark, 1, 600)
    ids = sorted(x)
    m = np.stack([x[i] for i in ids])
    rows = kmtree.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append((r["rank"], -r.score, r.vec_id))
    asked = [i for i in ids if i % 20 == 0]
    assert sorted(by) == asked
    hit = 0
    for q in asked:
        got = sorted(by[q])
        assert [g[0] for g in got] == list(range(1, 21))
        assert [g[1:] for g in got] == sorted(g[1:] for g in got)
        score = (m * x[q]).sum(1)
        for _, s, v in got:
            assert v != q and abs(-s - score[ids.index(v)]) < 1e-12
        best = sorted((-score[k], i) for k, i in enumerate(ids) if i != q)[:20]
        hit += len({i for _, i in best} & {g[2] for g in got})
    assert hit / (20 * len(asked)) >= 0.9
    # Copies: vectors 40..59 are equal, so ties go to the smaller ids.
    copies = [v for _, _, v in sorted(by[40]) if 40 <= v < 60]
    assert copies == list(range(41, 41 + len(copies))) and copies
    assert kmtree.nearest(df.limit(0), F.lit(True)).count() == 0


def test_fewer_candidates_than_asked(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    rows = kmtree.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in rows] == [(20, 1, 2, 1.0), (20, 2, 1, 0.5)]


def planted(seed, n, pairs, dims=64):
    """Unit vectors and, beside the first `pairs` of them, others at cosines from 0.902 to 0.93."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = rng.standard_normal((pairs, dims))
    other -= (other * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    c = rng.uniform(0.902, 0.93, (pairs, 1))
    return np.r_[x, c * x[:pairs] + np.sqrt(1 - c * c) * other]


def test_recall_on_planted_pairs(spark):
    """Pairs near the threshold, in trees whose levels are all of the sample's, and in trees most of whose levels are below."""
    x = planted(7, 4000, 800)
    df = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    for options in ({"leaf": 64}, {"leaf": 64, "most_depth": 2}, {"leaf": 64, "sample_rows": 60}):
        rows = {r.vec_id: r for r in rpforest.near_vectors(df, 0.9, **options).collect()}
        found = sum(rows[4000 + i].component_id == i for i in range(800))
        assert found >= 0.99 * 800, options
        assert sum(r.n_links for r in rows.values()) == 2 * found


def test_leaves_below_the_sample_are_small_and_spill():
    x = planted(3, 6000, 0)
    tree = rpforest.grow(x[:500], 1, 3, 4, 0.04)[0]
    row, leaf = tree.leaves(x)
    assert set(row.tolist()) == set(range(len(x)))
    sizes = np.bincount(leaf - (2**7 - 1))
    assert len(sizes) <= 128 and sizes.max() < 4 * len(row) / 128
    assert len(x) < len(row) < 2 * len(x)


def test_a_pair_at_the_threshold_links(spark):
    """cosine exactly 0.9 in doubles, whatever the last bits of a matrix product are."""
    a, b = [0.9, 0.4358898943540674] + [0.0] * 14, [1.0] + [0.0] * 15
    rest = np.random.default_rng(2).standard_normal((30, 16)).tolist()
    df = spark.createDataFrame([(1, a), (2, b), *((10 + i, r) for i, r in enumerate(rest))], "vec_id long, embedding array<double>")
    u, v = (rpforest._unit(np.array([r]))[0] for r in (a, b))
    want = int((u * v).sum() >= 0.9)
    assert [r.n_links for r in rpforest.near_vectors(df).where("vec_id < 3").orderBy("vec_id").collect()] == [want, want]


def test_each_length_is_searched_by_itself(spark):
    rng = np.random.default_rng(5)
    x = {i: rng.standard_normal(16 if i % 3 else 8) for i in range(300)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "vec_id long, embedding array<double>")
    rows = kmtree.nearest(df, F.col("vec_id") % 20 == 0, 5, recall=1.0).collect()
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q in range(0, 300, 20):
        best = sorted((-float((v * x[q]).sum()), i) for i, v in x.items() if i != q and len(v) == len(x[q]))[:5]
        assert {i for _, i in best} == {i for _, i in got[q]}


def test_small_leaves_are_not_the_end_of_a_search(spark):
    """Clusters smaller than the number asked for: a query goes on until it has met enough candidates."""
    rng = np.random.default_rng(9)
    centers = rng.standard_normal((60, 16)) * 20
    x = np.repeat(centers, 6, axis=0) + 0.01 * rng.standard_normal((360, 16))
    df = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    rows = kmtree.nearest(df, F.col("vec_id") % 20 == 0, 20, recall=0.1).groupBy("query_id").count().collect()
    assert len(rows) == 18 and {r["count"] for r in rows} == {20}
