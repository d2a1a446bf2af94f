"""Components of graphs whose shapes or orders of ids make rounds many, against a plain union."""

import random

import pytest

from taintloom.llm import components as C

from .helpers import united


def rounds_and_roots(spark, pairs, monkeypatch):
    taken = []
    plain = C._pointers
    monkeypatch.setattr(C, "_pointers", lambda e, k: taken.append(k) or plain(e, k))
    df = spark.createDataFrame(pairs, "a long, b long")
    found = {r.node: r.root for r in C.components(df).collect()}
    return len(taken), found


def named(n, order, seed=1):
    ids = list(range(n))
    if order == "descending":
        ids.reverse()
    elif order == "shuffled":
        random.Random(seed).shuffle(ids)
    return ids


def expected(n, ids, pairs):
    roots = united(n, pairs)
    low = {}
    for k, r in enumerate(roots):
        low[r] = min(low.get(r, ids[k]), ids[k])
    met = {k for p in pairs for k in p}
    return {ids[k]: low[roots[k]] for k in met}


@pytest.mark.parametrize("order", ["ascending", "descending", "shuffled"])
def test_a_path_of_100000_nodes(spark, monkeypatch, order):
    n = 100_000
    ids = named(n, order)
    df = spark.createDataFrame([(ids[k], ids[k + 1]) for k in range(n - 1)], "a long, b long")
    taken = []
    plain = C._pointers
    monkeypatch.setattr(C, "_pointers", lambda e, k: taken.append(k) or plain(e, k))
    out = C.components(df)
    assert out.count() == n and out.where("root <> 0").count() == 0
    assert len(taken) <= 20


@pytest.mark.parametrize(("shape", "order"), [("star", "shuffled"), ("comb", "ascending"), ("two", "shuffled")])
def test_other_shapes(spark, monkeypatch, shape, order):
    n = 600
    ids = named(n, order, 2)
    if shape == "star":
        pairs = [(n - 1, k) for k in range(n - 1)]
    elif shape == "comb":
        pairs = [(k, k + 2) for k in range(0, n - 2, 2)] + [(k, k + 1) for k in range(0, n, 2)]
    else:  # a hub with a third of all edges, cliques, and single pairs, with repeated, reversed and self edges
        pairs = [(0, k) for k in range(1, 200)] + [(i, j) for i in range(210, 230) for j in range(210, 230)] + [(k, k + 1) for k in range(300, 598, 3)]
        pairs += [(k, 0) for k in range(50, 60)] + pairs[:5]
    taken, found = rounds_and_roots(spark, [(ids[a], ids[b]) for a, b in pairs], monkeypatch)
    want = expected(n, ids, [p for p in pairs if p[0] != p[1]])
    assert found == want
    assert taken <= 12


def test_nulls_and_no_edges(spark):
    df = spark.createDataFrame([(1, None), (None, 2), (3, 3)], "a long, b long")
    assert C.components(df).collect() == []
    more = df.union(spark.createDataFrame([(-5, 7), (7, -9)], "a long, b long"))
    assert sorted(map(tuple, C.components(more).collect())) == [(-9, -9), (-5, -9), (7, -9)]
