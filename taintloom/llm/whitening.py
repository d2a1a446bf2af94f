"""Operator 13, embedding whitening: counts, means and centred scatters of partitions merged pairwise by Chan's formula in a
treeReduce, an eigendecomposition of the one matrix on the driver, and a second pass that verifies the identity.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .rpforest import matrix

#: Rows whose scatter is made by one product.
ROWS = 4096
#: So many lengths of vectors are whitened, each by itself.
MOST_WIDTHS = 64


@dataclass
class Moments:
    """Count, mean and centred scatter of some rows; of integers also their sums, exactly (Python integers)."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    sums: list[int] | None = None

    def merged(self, other: Moments) -> Moments:
        """Chan's pairwise formula. Sums of integers give the means' difference without cancellation."""
        n = self.n + other.n
        sums = None
        if self.sums is None or other.sums is None:
            delta = other.mean - self.mean
        else:
            delta = np.array([(b * self.n - a * other.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums, strict=True)])
            sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        scatter = self.scatter + other.scatter + np.outer(delta, delta) * (self.n * other.n / n)
        return Moments(n, self.mean + delta * (other.n / n), scatter, sums)


def _largest(x: np.ndarray) -> int:
    return max(-int(x.min(initial=0)), int(x.max(initial=0)))


def moments(x: np.ndarray) -> Moments:
    """Of the rows of x, integers or doubles."""
    y = x.astype(np.float64)
    mean = y.mean(0)
    y -= mean
    rest = y.mean(0)  # what rounding left of the mean
    y -= rest
    sums = None
    if x.dtype == np.int64:
        sums = [int(s) for s in (x if _largest(x) * len(x) < 2**62 else x.astype(object)).sum(0)]
    return Moments(len(x), mean + rest, y.T @ y, sums)


def merge_all(left: dict[int, Moments], right: dict[int, Moments]) -> dict[int, Moments]:
    """Moments by length of vectors; those of both sides are merged."""
    out = dict(left)
    for width, m in right.items():
        out[width] = out[width].merged(m) if width in out else m
    return out


def quantised(vector: Column, scale: int) -> Column:
    """Each entry as floor(scale * entry), a long; entries beyond a long's range are its ends."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(F.lit(float(scale)) * c))


def finite(vector: Column) -> Column:
    """Not null, and no entry is null, NaN or infinite. An empty vector is finite."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def _integers(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(len(column), -1)


def _by_width(column: pa.Array):
    """(width, places of its rows, their integers) of a list column, in blocks of at most ROWS rows."""
    width = np.diff(column.offsets.to_numpy())
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        for k in range(0, len(at), ROWS):
            part = at[k : k + ROWS]
            yield w, part, _integers(column.take(pa.array(part)))


def summed(fit: DataFrame, depth: int = 3, project=None) -> dict[int, Moments]:
    """Moments by length of the vectors `x` of `fit`: of each partition in its task, then merged in a tree of `depth` levels
    over the tasks, so that the driver meets few matrices at any number of partitions. `project(width, integers)` gives
    the rows that are summed instead of the integers themselves."""

    def run(batches):
        held: dict[int, Moments] = {}
        for b in batches:
            for w, _, x in _by_width(b.column(0)):
                held = merge_all(held, {w: moments(x if project is None else project(w, x))})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)], pa.binary())], names=["moments"])

    return fit.select("x").mapInArrow(run, "moments binary").rdd.map(lambda row: pickle.loads(row[0])).treeReduce(merge_all, depth)


@dataclass
class Whitening:
    """Of one length of vectors: number and sums of the fit list, components (columns) and their eigenvalues, what they
    explain of the trace, and the largest entry of the whitened covariance minus the identity (None: not measured)."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: list[float | None]
    error: float | None = None

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Rows of integers minus the mean, exactly centred before they are rounded, on the components over the roots of
        their eigenvalues; NaN for a component without an eigenvalue over zero."""
        whole = np.array([s // self.n for s in self.sums], object)
        part = np.array([s % self.n / self.n for s in self.sums])
        if _fits(x, whole):
            centred = (x - whole.astype(np.int64)).astype(np.float64) - part
        else:
            centred = (x.astype(object) - whole).astype(np.float64) - part
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, centred @ self.components / np.sqrt(self.values), np.nan)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sum) ** 2, exactly; None where it is beyond a long."""
        most = self.n * _largest(x) + max(map(abs, self.sums))
        if most * most * len(self.sums) < 2**63:
            d = self.n * x - np.array(self.sums, np.int64)
            return (d * d).sum(1).tolist()
        d = x.astype(object) * self.n - np.array(self.sums, object)
        return [int(v) if v < 2**63 else None for v in (d * d).sum(1)]


def _fits(x: np.ndarray, whole: np.ndarray) -> bool:
    return max(_largest(x), *(abs(v) for v in whole)) < 2**62


def fitted(m: Moments, most: int = 4) -> Whitening:
    """Components of the covariance m.scatter / m.n by falling eigenvalue. Each has a sign of its own: its largest entry is
    positive. Eigenvalues that rounding alone explains are zero."""
    values, vectors = np.linalg.eigh(m.scatter / m.n)
    order = np.argsort(-values, kind="stable")[:most]
    values, vectors = values[order], vectors[:, order]
    trace = float(np.trace(m.scatter) / m.n)
    noise = len(m.mean) * np.finfo(float).eps * trace
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    values = np.where(values > noise, values, 0.0)
    return Whitening(m.n, m.sums, vectors * signs, values, [float(v) / trace if trace > 0 else None for v in values])


def whitening(rows: DataFrame, most: int = 4, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per row of `rows` with a finite vector, and component up to `most`: (key, component, n, deviation, whitened,
    explained, identity_error).

    Entries become integers x = floor(scale * entry). The fit list holds every distinct x once: n vectors with sums S.
    Components are unit eigenvectors of its covariance, from 1 by falling eigenvalue e. deviation: the sum of (n * x - S)
    ** 2 (null beyond a long); whitened: x - S / n on the component over sqrt(e); explained: e over the covariance's
    trace; identity_error: the largest absolute entry of the covariance of the fit list's whitened components minus the
    identity, measured in a second pass.

    Rows whose vector is null or holds null or non-finite entries go. Vectors of each length are fitted and whitened by
    themselves (more than MOST_WIDTHS lengths are an error); empty ones have no component, so no row. A component
    whose eigenvalue is zero (fewer distinct vectors than components, or constant entries) has null whitened values and
    no part in identity_error, which is null if there is no other; explained is null if the trace is zero. Repeated
    rows and null keys each give their own rows; copies of a vector, however many, are one of the fit list. An empty
    table gives an empty result; other columns are not read.

    The distinct vectors are the only shuffle. Tasks and the driver hold matrices of the vectors' length, no rows.
    """
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    good = rows.where(finite(F.col(vector)) & (F.size(vector) > 0)).select(F.col(key).alias("k"), quantised(F.col(vector), scale).alias("x"))
    fit = cut(good.select("x").distinct())
    widths = fit.select(F.size("x")).distinct().limit(MOST_WIDTHS + 1).count()
    if widths > MOST_WIDTHS:
        raise ValueError(f"vectors have more than {MOST_WIDTHS} lengths")
    if not widths:
        return spark.createDataFrame([], schema)
    models = {w: fitted(m, most) for w, m in summed(fit).items()}
    shared = spark.sparkContext.broadcast(models)

    def project(w, x):
        model = shared.value[w]
        return model.whitened(x)[:, model.values > 0]

    for w, m in summed(fit, project=project).items():
        if m.scatter.size:
            models[w].error = float(np.abs(m.scatter / m.n - np.eye(len(m.scatter))).max())
    final = spark.sparkContext.broadcast(models)

    def run(batches):
        for b in batches:
            for w, at, x in _by_width(b.column(1)):
                model = final.value[w]
                c = len(model.values)
                z = model.whitened(x)
                taken = pa.array(np.repeat(at, c))
                deviation = [d for d in model.deviations(x) for _ in range(c)]
                columns = [
                    b.column(0).take(taken),
                    pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(at) * c, model.n, np.int64)),
                    pa.array(deviation, pa.int64()),
                    pa.array(z.ravel(), pa.float64(), mask=np.isnan(z).ravel()),
                    pa.array(model.explained * len(at), pa.float64()),
                    pa.array([model.error] * (len(at) * c), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return good.mapInArrow(run, schema)
