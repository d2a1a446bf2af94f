"""Whitening against plain numpy and exact integers."""

import math

import numpy as np

from taintloom.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component int"


def plain(rows):
    """{vec_id: x}, and n, sums, mean, eigenvalues and eigenvectors by falling eigenvalue of the distinct x."""
    xs = [(i, [math.floor(256.0 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in xs})
    n = len(fit)
    sums = [sum(c) for c in zip(*fit, strict=True)]
    a = np.array(fit, float)
    y = a - a.mean(0)
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    return xs, n, sums, a.mean(0), e[::-1], u[:, ::-1], cov


def check(rows, out, most=4):
    xs, n, sums, mean, e, u, cov = plain(rows)
    by = {}
    for r in out:
        by.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r)
    assert sorted(by) == list(range(1, most + 1))
    for c, mine in by.items():
        assert sorted(mine) == sorted({i for i, _ in xs}) and sum(map(len, mine.values())) == len(xs)
        z = []
        for i, x in xs:
            r = mine[i][0]
            assert r.n == n
            assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
            assert abs(r.explained - e[c - 1] / np.trace(cov)) <= 1e-9 * r.explained
            assert 0 <= r.identity_error <= 1e-4
            z.append((r.whitened, float((np.array(x) - mean) @ u[:, c - 1]) / math.sqrt(e[c - 1])))
        z = np.array(z)
        sign = np.sign((z[:, 0] * z[:, 1]).sum())
        assert np.abs(z[:, 0] - sign * z[:, 1]).max() < 1e-6


def test_the_query_equals_numpy(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(rows, queries.op13_embedding_whitening(spark, sf).collect())


def test_copies_odd_rows_and_large_means(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 6)) * [9, 5, 3, 2, 1, 0.5] + 50_000
    x[100:300] = x[100]
    rows = [(i, [float(v) for v in np.float32(r)]) for i, r in enumerate(x)] + [(7, [float(v) for v in np.float32(x[7])])]
    odd = [(900, None), (901, [1.0, None] + [0.0] * 4), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + odd], SCHEMA).repartition(7)
    check(rows, whitening.whitening(df).collect())
    assert whitening.whitening(df.limit(0)).collect() == []
    assert whitening.whitening(df.where("vec_id >= 900")).collect() == []


def test_partitions_in_any_number_give_the_same_moments():
    rng = np.random.default_rng(4)
    x = rng.integers(-300, 300, (500, 5)) + 10**9
    whole = whitening.moments(x)
    for cuts in ([100], [1, 2, 3], list(range(1, 500))):
        parts = [whitening.moments(p) for p in np.split(x, cuts)]
        while len(parts) > 1:
            parts = [parts[k].merged(parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        assert parts[0].n == 500 and parts[0].sums == whole.sums == x.sum(0).tolist()
        assert np.allclose(parts[0].mean, whole.mean, rtol=1e-15) and np.allclose(parts[0].scatter, whole.scatter, rtol=1e-12, atol=1e-4)


def test_few_vectors_constant_entries_and_lengths(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<double>")
    rows = whitening.whitening(one).collect()
    assert len(rows) == 6 and {(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in rows} == {(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)}
    two = spark.createDataFrame([(1, [1.0, 2.0, 0.0]), (2, [1.5, 2.0, 0.0]), (3, [7.0]), (4, [8.0]), (5, [])], "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.component): r for r in whitening.whitening(two).collect()}
    assert sorted(got) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 1), (4, 1)]
    assert abs(got[1, 1].whitened) == abs(got[2, 1].whitened) == 1.0 and got[1, 1].whitened == -got[2, 1].whitened
    assert got[1, 2].whitened is None and got[1, 1].explained == 1.0 and got[1, 1].identity_error < 1e-9
    assert got[3, 1].n == 2 and abs(got[3, 1].whitened) == 1.0 and got[3, 1].deviation == 256**2


def test_entries_beyond_a_long(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    rows = {(r.vec_id, r.component): r for r in whitening.whitening(df).collect()}
    assert rows[1, 1].deviation is None and rows[3, 1].deviation == (0 + 1) ** 2 + (3 * 512 - 768) ** 2
    assert abs(rows[1, 1].whitened) > 1


def test_more_lengths_than_allowed(spark):
    df = spark.createDataFrame([(k, [1.0] * k) for k in range(1, whitening.MOST_WIDTHS + 2)], "vec_id long, embedding array<double>")
    try:
        whitening.whitening(df)
    except ValueError as e:
        assert "lengths" in str(e)
    else:
        raise AssertionError
