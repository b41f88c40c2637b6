"""Embedding whitening: the main components of vectors, each with unit variance."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: An entry c counts as floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Entries of this size and more are no longer whole 64-bit numbers when scaled; their vectors count as not finite.
LARGEST = float(2**52)
#: The moments of partitions are merged by so many tasks before they reach the driver.
MERGERS = 16
ROWS = 1024


class Moments:
    """Count, mean and sum of outer products of deviations (divide by n for the covariance)."""

    def __init__(self, dim: int):
        self.n, self.mean, self.outer = 0, np.zeros(dim), np.zeros((dim, dim))

    def add(self, row: np.ndarray) -> None:
        """Welford's step: one row changes the mean and adds one product of rank one."""
        self.n += 1
        away = row - self.mean
        self.mean += away / self.n
        self.outer += np.multiply.outer(away, away * ((self.n - 1) / self.n))

    def merge(self, other: Moments) -> None:
        """The parallel form: two parts' moments and the distance of their means."""
        if not other.n:
            return
        n = self.n + other.n
        away = other.mean - self.mean
        self.mean = self.mean + away * (other.n / n)
        self.outer = self.outer + other.outer + np.multiply.outer(away, away) * (self.n * other.n / n)
        self.n = n

    def covariance(self) -> np.ndarray:
        half = self.outer / self.n
        return (half + half.T) / 2


@dataclass
class Whitening:
    """``sums`` are whole numbers over ``n`` vectors; ``axes`` has one unit eigenvector in each row, ``values`` their eigenvalues, falling."""

    dim: int
    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    axes: np.ndarray
    identity_error: float = 0.0


_STATE = "dim int, n long, sums array<string>, mean array<double>, outer array<double>"


def _usable(vectors: DataFrame, vector_col: str, *others) -> DataFrame:
    """Rows whose vector has entries, all of them finite; only the columns that are named are read."""
    rows = vectors.select(*others, F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    return rows.where(F.size("v") > 0).where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)))


def _whole(column: pa.Array):
    """For each length of vectors in a column: (rows, their entries as whole numbers), some rows at a time."""
    sizes = column.value_lengths().to_numpy()
    ends, entries = np.cumsum(sizes), column.flatten().to_numpy()
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        for at in range(0, len(rows), ROWS):
            some = rows[at : at + ROWS]
            yield some, np.floor(entries[(ends[some] - dim)[:, None] + np.arange(dim)] * SCALE).astype(np.int64) + OFFSET


def _row(dim: int, sums: list[int], m: Moments) -> pa.RecordBatch:
    cells = [[dim], [m.n], [[str(s) for s in sums]], [m.mean.tolist()], [m.outer.ravel().tolist()]]
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names=["dim", "n", "sums", "mean", "outer"])


def _accumulate(batches):
    """One row per partition and length of vectors: exact sums and Welford's moments."""
    sums: dict[int, list[int]] = {}
    moments: dict[int, Moments] = {}
    for batch in batches:
        for _, x in _whole(batch.column(0)):
            dim = x.shape[1]
            m = moments.setdefault(dim, Moments(dim))
            small = int(np.abs(x).max()) < 1 << 50
            total = (x if small else x.astype(object)).sum(axis=0).tolist()
            sums[dim] = [a + b for a, b in zip(sums.get(dim, [0] * dim), total)]
            for row in (x - OFFSET).astype(float):
                m.add(row)
    for dim, m in moments.items():
        yield _row(dim, sums[dim], m)


def _merged(rows) -> dict[int, tuple[list[int], Moments]]:
    out: dict[int, tuple[list[int], Moments]] = {}
    for dim, n, sums, mean, outer in rows:
        part = Moments(dim)
        part.n, part.mean, part.outer = n, np.array(mean), np.array(outer).reshape(dim, dim)
        known, m = out.setdefault(dim, ([0] * dim, Moments(dim)))
        m.merge(part)
        known[:] = [a + int(b) for a, b in zip(known, sums)]
    return out


def _merge(batches):
    rows = (tuple(c[i].as_py() for c in batch.columns) for batch in batches for i in range(batch.num_rows))
    for dim, (sums, m) in _merged(rows).items():
        yield _row(dim, sums, m)


def _gather(states: DataFrame) -> dict[int, tuple[list[int], Moments]]:
    """A partition's moments have the square of the length; tasks merge them, so the driver has a fixed number of them at any size of the input."""
    return _merged(states.repartition(MERGERS).mapInArrow(_merge, _STATE).toLocalIterator())


def symmetric_qr(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in rows, of a symmetric matrix.

    Householder reflections make it tridiagonal; implicit QR steps with Wilkinson's shift take its side entries to zero from the lower end.
    """
    a = np.array(matrix, float)
    n, tiny = len(a), np.finfo(float).eps
    q = np.eye(n)  # row i ends as the i-th eigenvector
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        if not v[1:].any():
            continue
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        for part in (a[k + 1 :, :], a[:, k + 1 :].T, q[k + 1 :, :]):
            part -= 2 * np.multiply.outer(v, v @ part)
    d, e = np.diag(a).copy(), np.diag(a, 1).copy()
    least = tiny * tiny * np.abs(a).max(initial=0)
    hi = n - 1
    while hi > 0:
        e[:hi][np.abs(e[:hi]) <= tiny * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1])) + least] = 0
        if e[hi - 1] == 0:
            hi -= 1
            continue
        lo = hi - 1
        while lo and e[lo - 1]:
            lo -= 1
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + np.copysign(np.hypot(half, e[hi - 1]), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = np.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            d0, d1, e0 = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * d0 + 2 * c * s * e0 + s * s * d1, s * s * d0 - 2 * c * s * e0 + c * c * d1
            x = e[k] = c * s * (d1 - d0) + (c * c - s * s) * e0
            if k < hi - 1:
                z, e[k + 1] = s * e[k + 1], c * e[k + 1]
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-d, kind="stable")
    return d[order], q[order] / np.linalg.norm(q[order], axis=1, keepdims=True)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: in 64 bits where they suffice with their squares, else in Python's numbers."""
    bound = n * max(int(np.abs(x).max()), 1) + max(map(abs, sums))
    if bound < 1 << 62:
        out = n * x - np.array(sums)
        if int(np.abs(out).max()) ** 2 * x.shape[1] < 1 << 63:
            return out
    return n * x.astype(object) - np.array(sums, object)


def _project(away: np.ndarray, model: Whitening) -> np.ndarray:
    return (away / model.n).astype(float) @ model.axes.T / np.sqrt(model.values)


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = 8) -> Whitening | None:
    """The model of all usable vectors: each partition updates Welford's moments row by row, parts merge by the parallel formula, and the driver solves one
    matrix of the vectors' length. A second pass whitens all vectors and measures how far their covariance is from the identity.

    Vectors that are null, empty or hold a null, a non-finite entry or one of 2^52 and more are left out. Vectors of another length than the most frequent one
    (of equally frequent ones the longest) are left out, too. Components without variance beyond rounding cannot be whitened and are left out: equal vectors,
    or a single one, have none. Without usable vectors there is no model (None).
    """
    rows = _usable(vectors, vector_col)
    found = _gather(rows.mapInArrow(_accumulate, _STATE))
    if not found:
        return None
    dim = max(found, key=lambda k: (found[k][1].n, k))
    sums, moments = found[dim]
    cov = moments.covariance()
    values, axes = symmetric_qr(cov)
    some = values[:components] > max(values[0], 0) * dim * np.finfo(float).eps
    model = Whitening(dim, moments.n, sums, float(np.trace(cov)), values[:components][some], axes[:components][some])

    def measure(batches):
        m = Moments(len(model.values))
        for batch in batches:
            for _, x in _whole(batch.column(0)):
                if x.shape[1] == dim:
                    for row in _project(_deviations(x, model.n, sums), model):
                        m.add(row)
        if m.n:
            yield _row(len(m.mean), [], m)

    if len(model.values):
        _, white = _gather(rows.mapInArrow(measure, _STATE))[len(model.values)]
        model.identity_error = float(np.abs(white.covariance() - np.eye(len(model.values))).max())
    return model


def whiten(vectors: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector of the model's length and component: the id, ``component`` from 1, ``n``, ``deviation`` (a decimal: the sum over entries of
    (n * x - sum)^2, exact, null beyond 38 digits), ``whitened``, ``explained`` (the share of the variance) and ``identity_error``.

    Nothing is shuffled; the model is a matrix of a fixed size. Null and repeated ids keep a row each; columns with other names are not read. Tables without usable
    vectors, and those whose vectors are all equal, give no rows.
    """
    key = vectors.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", key), T.StructField("component", T.IntegerType()), T.StructField("deviation", T.StringType()), T.StructField("whitened", T.DoubleType())])
    k = len(model.values) if model else 0

    def run(batches):
        for batch in batches:
            for rows, x in _whole(batch.column(1)):
                if not k or x.shape[1] != model.dim:
                    continue
                away = _deviations(x, model.n, model.sums)
                far = (away * away).sum(axis=1).tolist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                     pa.array([str(f) for f in far for _ in range(k)], pa.string()), pa.array(_project(away, model).ravel())],
                    names=["id", "component", "deviation", "whitened"],
                )

    out = _usable(vectors, vector_col, F.col(f"`{id_col}`").alias("id")).select("id", "v").mapInArrow(run, schema)
    shares = (model.values / model.trace).tolist() if k else [0.0]
    return out.select(
        F.col("id").alias(id_col), "component", F.lit(model.n if model else 0).cast("long").alias("n"), F.expr("try_cast(deviation AS DECIMAL(38, 0))").alias("deviation"), "whitened",
        F.element_at(F.array(*map(F.lit, shares)), F.col("component")).alias("explained"), F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )
