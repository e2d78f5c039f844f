"""Whitening of embeddings by QDWH spectral divide-and-conquer.

Entries become whole numbers x = floor(64 * c) + 1000000.  The fit list is each distinct
x vector once; its covariance V is summed over tasks from entries centred before they
are multiplied.  V (dimension squared, at most ``MAX_DIM`` on a side) is split on the
driver: the polar factor U of V - s*I, by dynamically weighted Halley iterations with QR
(QDWH), gives the projector (U + I) / 2 onto the invariant subspace of eigenvalues above
s; V is restricted to it and to its complement, and each part is split again until
parts are single components (or multiples of the identity).  Parts below the wanted
number of components are not split.  The components (at most ``top`` rows) are sent to
the tasks, which whiten all rows.

Sums are whole numbers, so n, S and the deviation are exact; only V has rounding.

Edge cases: vectors that are null, or hold null or non-finite entries, are dropped;
so are vectors of another length than the table's most frequent one (the longer of two
as frequent; length 0 never counts).  Entries beyond 2**52 / 64 are clipped there.  A
deviation that doesn't fit a long is null.  Components without variance can't be scaled
and are left out (a single distinct vector has none, hence no rows).  Repeated rows and
null vec_ids give a set of rows each.  An empty table gives no rows.  Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship_package

SCALE, SHIFT = 64, 1_000_000
TOP = 16
MAX_DIM = 8192  # a covariance of 512 MB; beyond it the fit says so instead of filling the driver
_EPS = np.finfo(np.float64).eps


def whole_numbers(column: str) -> Column:
    """The entries of a vector as whole numbers; null unless all are finite."""
    edge = F.lit(float(1 << 52))
    entry = lambda c: c.cast("double")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(entry(c)) == F.lit(float("inf")))
    to_long = lambda c: F.floor(F.least(F.greatest(entry(c) * F.lit(float(SCALE)), -edge), edge)).cast("long") + F.lit(SHIFT)
    return F.when(F.col(column).isNotNull() & ~F.exists(column, bad), F.transform(column, to_long))


# -- spectral divide and conquer ---------------------------------------------------------


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QDWH iterations."""
    n = len(a)
    scale = np.linalg.norm(a)
    x = a / scale
    # a lower bound for the least singular value; one too low only costs a round
    low = max(_EPS, 1 / (np.linalg.cond(x, 1) * np.sqrt(n))) if n > 1 else 1.0
    if not np.isfinite(low):
        low = _EPS
    for _ in range(40):
        d = np.cbrt(4 * (1 - low * low) / low**4)
        h = np.sqrt(1 + d) + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low * low) / (low * low * np.sqrt(1 + d))))
        b = (h - 1) ** 2 / 4
        c = h + b - 1
        q, _r = np.linalg.qr(np.vstack((np.sqrt(c) * x, np.eye(n))))
        new = (b / c) * x + ((h - b / c) / np.sqrt(c)) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x = new
        low = min(1.0, low * (h + b * low * low) / (1 + c * low * low))
        if abs(1 - low) < 10 * _EPS and moved < np.cbrt(_EPS) * 10:
            break
    return x


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two invariant subspaces, that of the larger eigenvalues first;
    None where the eigenvalues are equal to working precision."""
    n = len(a)
    diagonal = np.diag(a)
    mean = diagonal.mean()
    spread = np.linalg.norm(a - mean * np.eye(n))
    size = max(np.linalg.norm(a), np.finfo(np.float64).tiny)
    if spread <= 2 * n * _EPS * size:
        return None
    rng = np.random.default_rng(n)
    # the median halves the work; the mean lies strictly between the extreme eigenvalues
    for k, shift in enumerate((float(np.median(diagonal)), float(mean), *(float(mean + spread / n * f) for f in (1e-3, -1e-3, 1e-2, -1e-2, 0.1, -0.1)))):
        u = polar(a - shift * np.eye(n)) if np.linalg.norm(a - shift * np.eye(n)) > 0 else np.zeros((n, n))
        p = (u + np.eye(n)) / 2
        rank = int(round(float(np.trace(p))))
        if not 0 < rank < n or np.linalg.norm(p @ p - p) > 1e-8 * n:
            continue
        basis = np.linalg.qr(p @ rng.standard_normal((n, rank)))[0]
        basis = np.linalg.qr(p @ basis)[0]
        both = np.linalg.qr(np.hstack((basis, rng.standard_normal((n, n - rank)))))[0]
        upper, lower = both[:, :rank], both[:, rank:]
        if np.linalg.norm(upper.T @ a @ lower) <= 1e-10 * size:
            return upper, lower
    return None


def components(v: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` largest eigenvalues of a symmetric matrix, falling, and their unit
    eigenvectors as columns; eigenvalues that are zero to working precision are left out."""
    dim = len(v)
    floor = dim * _EPS * max(float(np.trace(v)), 0.0)
    done: list[tuple[float, np.ndarray]] = []
    work = [(v, np.eye(dim))]  # parts on top hold larger eigenvalues
    while work and len(done) < top:
        a, basis = work.pop()
        halves = _split(a) if len(a) > 1 else None
        if halves is None:
            done += [(float(basis[:, k] @ v @ basis[:, k]), basis[:, k]) for k in range(len(a))]
            continue
        for half in reversed(halves):
            inner = half.T @ a @ half
            work.append(((inner + inner.T) / 2, basis @ half))
    done = sorted((x for x in done if x[0] > floor), key=lambda x: -x[0])[:top]
    if not done:
        return np.zeros(0), np.zeros((dim, 0))
    return np.array([e for e, _ in done]), np.stack([w for _, w in done], axis=1)


# -- fit ---------------------------------------------------------------------------------


@dataclass
class Whitening:
    """A fitted whitening: exact n and S, eigenvalues and unit vectors (as columns) of the
    components, the trace of V."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, from the whole and the fractional part of the mean."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole) - part

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)**2, exact."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = [s % self.n for s in self.sums]
        y = x - whole
        if len(y) and (int(np.abs(y).max()) + 1) ** 2 * self.n**2 * len(part) < 1 << 62:
            z = y * self.n - np.array(part, np.int64)
            return (z * z).sum(axis=1).tolist()
        exact = (sum((a * self.n - p) ** 2 for a, p in zip(row, part)) for row in y.tolist())
        return [d if d < 1 << 63 else None for d in exact]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _summed(fit: DataFrame, dim: int, block) -> np.ndarray:
    """The sum over the fit list of ``block(x)``, a matrix of doubles: one partial sum per
    task, which Spark adds up cell by cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = block(_matrix(batch.column(0), dim))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "cells"])

    parts = fit.select("x").mapInArrow(run, "i int, cells array<double>")
    cells = parts.select("i", F.posexplode("cells").alias("j", "cell")).groupBy("i", "j").agg(F.sum("cell").alias("cell"))
    rows = cells.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "cell"))), lambda c: c["cell"]).alias("cells"))
    return np.array([r["cells"] for r in rows.sort("i").collect()])  # at most dim * dim


def fit(vectors: DataFrame, top: int = TOP) -> Whitening | None:
    """Fit on the distinct rows of ``vectors`` (x: arrays of whole numbers of one length);
    None for an empty table."""
    ship_package(vectors.sparkSession)
    distinct = materialise(vectors.select("x").distinct())
    size = distinct.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    n, dim = size["n"], size["d"]
    if not n:
        return None
    if dim > MAX_DIM:
        raise ValueError(f"{dim} dimensions: the covariance is held by the driver up to {MAX_DIM}")
    each = distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    sums = [int(r["s"]) for r in each.sort("i").collect()]  # one row per dimension
    model = Whitening(n, sums, np.zeros(0), np.zeros((dim, 0)), 0.0)

    def products(x: np.ndarray) -> np.ndarray:
        z = model.centred(x)
        return z.T @ z

    v = _summed(distinct, dim, products) / n
    values, unit = components((v + v.T) / 2, top)
    model = Whitening(n, sums, values, unit, float(np.trace(v)))
    k = len(values)
    if not k:
        return model

    def second(x: np.ndarray) -> np.ndarray:
        w = model.whitened(x)
        return np.vstack((w.sum(axis=0), w.T @ w))

    moments = _summed(distinct, dim, second) / n
    model.identity_error = float(np.abs(moments[1:] - np.outer(moments[0], moments[0]) - np.eye(k)).max())
    return model


def whole_vectors(table: DataFrame, column: str, *keep: str) -> DataFrame:
    """``keep`` and x for the rows whose vector is usable and of the table's usual length."""
    usable = table.select(*keep, whole_numbers(column).alias("x")).filter("x is not null and size(x) > 0")
    length = usable.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("c")).sort(F.desc("c"), F.desc("d")).first()
    return usable if length is None else usable.filter(F.size("x") == length["d"])


def whiten(table: DataFrame, column: str = "embedding", top: int = TOP) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every usable
    row of ``table`` (vec_id and the vector column) and component up to ``top``."""
    vectors = whole_vectors(table, column, "vec_id")
    model = fit(vectors, top)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return table.sparkSession.createDataFrame([], schema)
    k, dim = len(model.values), len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, (1 << 20) // max(dim, k))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = _matrix(part.column(1), dim)
                m = len(x)
                deviation = pa.array(model.deviations(x), pa.int64())
                each = pa.array(np.repeat(np.arange(m), k))
                cols = [
                    part.column(0).cast(pa.int64()).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                    deviation.take(each), pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.values / model.trace, m)),
                    pa.array(np.full(m * k, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(run, schema)
