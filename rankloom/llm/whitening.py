"""Whitening embeddings: streamed covariance, symmetric QR eigen-solve, projection.

The covariance of distinct vectors is gathered by Welford's rank-one updates in the
iterator of each partition, and the partitions' states are merged by the parallel update
formula in rounds of ``FAN_IN``, so no task holds more than that many states.  A state
is one mean and one square matrix of the vectors' length, whatever the rows; only the
last one reaches the driver, where the matrix is made tridiagonal by reflections and
then diagonal by shifted QR steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Vectors become whole numbers: floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this size count as this size, so that a whole number fits 64 bits.
FARTHEST = float(2**52)
FAN_IN = 8
STATE = "node int, n long, total array<long>, mean array<double>, scatter array<double>"


def usable(vector: Column) -> Column:
    """Neither null nor holding null or non-finite entries."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, bad), F.lit(False))


def whole_numbers(vector: Column) -> Column:
    """floor(64 * c) + 1000000 of each entry c, as longs."""
    held = lambda c: F.greatest(F.lit(-FARTHEST), F.least(F.lit(FARTHEST), F.lit(float(SCALE)) * c.cast("double")))
    return F.transform(vector, lambda c: F.floor(held(c)).cast("long") + F.lit(SHIFT))


def _matrix(column: pa.Array, dim: int, kind=np.int64) -> np.ndarray:
    """The rows of a list column whose lists all have ``dim`` entries."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, dim)


class Welford:
    """Count, mean and scatter (sum of centred outer products) of the rows seen so far; the total of whole numbers besides."""

    def __init__(self, dim: int):
        self.n, self.total, self.mean, self.scatter = 0, np.zeros(dim, np.int64), np.zeros(dim), np.zeros((dim, dim))
        self._outer = np.empty((dim, dim))

    def add(self, rows: np.ndarray) -> None:
        """One rank-one update for every row."""
        for row in rows:
            self.n += 1
            off = row - self.mean
            self.mean += off / self.n
            np.multiply.outer(off, row - self.mean, out=self._outer)
            self.scatter += self._outer

    def merge(self, n: int, total, mean, scatter) -> None:
        """The state of both sets of rows (the parallel update formula)."""
        both, off = self.n + n, np.asarray(mean) - self.mean
        self.scatter += np.reshape(scatter, self.scatter.shape) + np.multiply.outer(off, off) * (self.n * n / both)
        self.mean += off * (n / both)
        self.total += np.asarray(total)
        self.n = both

    def batch(self, node: int) -> pa.RecordBatch:
        lists = {"total": self.total, "mean": self.mean, "scatter": self.scatter.ravel()}
        return pa.RecordBatch.from_pydict({"node": pa.array([node], pa.int32()), "n": pa.array([self.n], pa.int64())} | {k: pa.array([v]) for k, v in lists.items()})


def covariance(rows: DataFrame, column: str, dim: int, before=None) -> Welford:
    """The state over all of ``rows``, whose ``column`` holds lists of ``dim`` whole numbers.

    ``before`` maps a matrix of them to the matrix whose covariance is wanted; without it
    the numbers themselves, less SHIFT, are taken.
    """
    width = before.width if before else dim

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Welford(width)
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            if before is None:
                state.total += x.sum(axis=0)
            state.add(before(x) if before else (x - SHIFT).astype(float))
        if state.n:
            yield state.batch(TaskContext.get().partitionId())

    def merge(states: pd.DataFrame) -> pd.DataFrame:
        out = Welford(width)
        for s in states.sort_values("node").itertuples():
            out.merge(s.n, s.total, s.mean, s.scatter)
        return pd.DataFrame({"node": [int(states["next"].iloc[0])], "n": [out.n], "total": [out.total], "mean": [out.mean], "scatter": [out.scatter.ravel()]})

    states = stage(rows.select(column).mapInArrow(gather, STATE), "whitening-states")
    last = states.agg(F.max("node").alias("last")).first()["last"]
    wide = 0 if last is None else last + 1
    while wide > 1:
        states = states.withColumn("next", F.floor(F.col("node") / FAN_IN).cast("int")).groupBy("next").applyInPandas(merge, STATE)
        wide = -(-wide // FAN_IN)
    out = Welford(width)
    for s in states.collect():  # one state
        out.merge(s["n"], s["total"], s["mean"], s["scatter"])
    return out


def _tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and the orthogonal q with q.T @ a @ q tridiagonal, by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        size = math.sqrt(float(x @ x))
        if size == 0 or not np.any(x[1:]):
            continue
        v = x.copy()
        v[0] += math.copysign(size, x[0])
        v /= math.sqrt(float(v @ v))
        p = a[k + 1 :, k + 1 :] @ v
        w = p - (v @ p) * v
        a[k + 1 :, k + 1 :] -= 2 * (np.multiply.outer(v, w) + np.multiply.outer(w, v))
        a[k + 1 :, k] = a[k, k + 1 :] = 0.0
        a[k + 1, k] = a[k, k + 1] = -math.copysign(size, v[0])
        q[:, k + 1 :] -= 2 * np.multiply.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, of a symmetric matrix.

    After the reduction to a tridiagonal matrix, implicit QR steps with Wilkinson's
    shift chase a bulge down each unreduced block until its last off-diagonal entry
    vanishes; the rotations are gathered in the eigenvectors.
    """
    d, e, q = _tridiagonal(np.asarray(a, float))
    rows, tiny = q.T.copy(), np.finfo(float).eps  # rotations act on neighbouring rows, which are contiguous
    hi, steps = len(d) - 1, 0
    while hi > 0:
        if abs(e[hi - 1]) <= tiny * (abs(d[hi - 1]) + abs(d[hi])):
            e[hi - 1] = 0.0
            hi, steps = hi - 1, 0
            continue
        lo = hi - 1
        while lo > 0 and abs(e[lo - 1]) > tiny * (abs(d[lo - 1]) + abs(d[lo])):
            lo -= 1
        steps += 1
        if steps > 300:
            raise ArithmeticError("the eigenvalues do not settle")
        half = (d[hi - 1] - d[hi]) / 2
        root = math.hypot(half, e[hi - 1])
        shift = d[hi] - e[hi - 1] * (e[hi - 1] / (half + math.copysign(root, half)))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            dk, dn, ek = d[k], d[k + 1], e[k]
            d[k] = c * c * dk + 2 * c * s * ek + s * s * dn
            d[k + 1] = s * s * dk - 2 * c * s * ek + c * c * dn
            e[k] = c * s * (dn - dk) + (c * c - s * s) * ek
            if k + 1 < hi:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            upper = c * rows[k] + s * rows[k + 1]
            rows[k + 1] = c * rows[k + 1] - s * rows[k]
            rows[k] = upper
    order = np.argsort(-d, kind="stable")
    return d[order], rows[order].T


@dataclass
class Whitener:
    """What the fit found: ``n`` distinct vectors, their total, the leading components and their shares."""

    dim: int
    n: int
    total: list[int]
    mean: np.ndarray  # of the whole numbers less SHIFT
    vectors: np.ndarray  # dim x width
    values: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    @property
    def width(self) -> int:
        return self.vectors.shape[1]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of rows of whole numbers; NaN on components without variance."""
        with np.errstate(divide="ignore"):
            scale = np.where(self.values > 0, 1 / np.sqrt(self.values), np.nan)
        return ((x - SHIFT) - self.mean) @ self.vectors * scale

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - total) squared, exact; None where it is beyond 64 bits."""
        total = np.array(self.total, object)
        most = max((abs(self.n * int(v) - t) for v, t in zip([*x.max(axis=0), *x.min(axis=0)], [*self.total, *self.total])), default=0) if len(x) else 0
        if most * most * self.dim < 2**63:
            off = self.n * x - np.array(self.total, np.int64)
            return (off * off).sum(axis=1).tolist()
        return [s if s < 2**63 else None for s in (int(((self.n * row.astype(object) - total) ** 2).sum()) for row in x)]


def fit(vectors: DataFrame, *, components: int = 16) -> Whitener | None:
    """Learn from the distinct vectors of x (vec_id, x): lists of whole numbers of one length; None without any."""
    first = vectors.select(F.size("x").alias("d")).limit(1).collect()
    if not first or first[0]["d"] < 1:
        return None
    dim = first[0]["d"]
    distinct = stage(vectors.select("x").distinct(), "whitening-distinct")
    state = covariance(distinct, "x", dim)
    v = state.scatter / state.n
    values, columns = symmetric_qr((v + v.T) / 2)
    trace = float(np.trace(v))
    top = min(components, dim)
    values = np.where(values[:top] > dim * np.finfo(float).eps * max(values[0], 0.0), values[:top], 0.0)
    total = [int(t) for t in state.total]
    # The exact mean, rounded once: the streamed one has gathered rounding errors.
    mean = np.array([(t - state.n * SHIFT) / state.n for t in total])
    out = Whitener(dim, state.n, total, mean, columns[:, :top], values, values / trace if trace > 0 else np.zeros(top))
    real = values > 0
    if real.any():
        after = covariance(distinct, "x", dim, out)
        out.identity_error = float(np.abs((after.scatter / after.n - np.eye(top))[np.ix_(real, real)]).max())
    return out


def whiten(embeddings: DataFrame, *, components: int = 16) -> DataFrame:
    """(vec_id, vector) -> vec_id, component, n, deviation, whitened, explained, identity_error; a row for each usable row and component.

    Rows whose vector is null or holds null or non-finite entries are left out.  Vectors
    must have one length to share a covariance: the commonest is taken (ties: the
    longer), and vectors of other lengths, empty ones among them, are left out too.
    Null and repeated vec_ids are rows like any other; repeated vectors count once
    in the fit.  Components without variance (fewer distinct vectors than components)
    have null ``whitened`` and 0 ``explained``; ``identity_error`` is that of the others, null
    if there are none.  ``deviation`` is null where it does not fit 64 bits.  No usable rows:
    no rows.  Other columns are ignored, whatever their names.
    """
    good = embeddings.select("vec_id", F.col("vector").alias("x")).where(usable(F.col("x"))).select("vec_id", whole_numbers(F.col("x")).alias("x"))
    kind = good.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    lengths = good.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("rows")).where("d > 0").orderBy(F.desc("rows"), F.desc("d")).limit(1).collect()
    model = fit(good.where(F.size("x") == lengths[0]["d"]), components=components) if lengths else None
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema)

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = model.width
        for batch in batches:
            x = _matrix(batch.column(1), model.dim)
            white, rows = model(x), len(x)
            each = np.repeat(np.arange(rows), width)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * width, model.n)),
                    pa.array(model.deviation(x), pa.int64()).take(pa.array(each)),
                    pa.array(white.ravel(), mask=np.isnan(white.ravel())),
                    pa.array(np.tile(model.explained, rows)),
                    pa.array([model.identity_error] * (rows * width), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return good.where(F.size("x") == model.dim).mapInArrow(project, schema)
