"""Whitening of vectors by their leading principal components, found by contour integration (FEAST).

Entries become longs ``floor(256 * c)``. The fit list holds each distinct vector once; its size n and sums S are
exact, and the covariance is the sum of products of the centred vectors, partial sums in tasks. Then, over the
d x d covariance V (d is the vectors' length, which bounds all that reaches the driver or is broadcast):

* *Interval.* The inertia of V - s (how many eigenvalues lie above s, from a tridiagonal form) is bisected for an
  interval that holds the wanted eigenvalues and few more.
* *Contour.* Quadrature points on a circle around the interval, one Spark task each: the complex system
  (z - V) X = Y is solved, and the weighted sum of the solutions projects Y onto the interval's eigenvectors.
* *Rayleigh-Ritz* in the projected space gives components; repeated until residuals are at rounding level.
* *Verification.* As many Ritz values must lie in the interval as the inertia counts say, else the space grows.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped; vectors of each length
have a fit of their own; an empty vector has no components and gives no row, like a component without variance
(an eigenvalue at or under 1e-11 of the largest), so one distinct vector gives none; repeated rows and rows
without id are rows of their own; of equal eigenvalues any orthonormal components. An entry whose long would not
fit is the nearest long, and a deviation beyond a long is null. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm.staging import arrow_map, stage

POINTS, ROUNDS, CHUNK = 8, 40, 2048
NO_VARIANCE = 1e-11


# -- inertia ---------------------------------------------------------------------------------------

def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix similar to the symmetric ``v`` (Householder)."""
    a = v.copy()
    d = len(a)
    off = np.zeros(max(d - 1, 0))
    for k in range(d - 2):
        x = a[k + 1:, k].copy()
        alpha = -np.copysign(np.linalg.norm(x), x[0])
        off[k] = alpha
        x[0] -= alpha
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        x /= norm
        sub = a[k + 1:, k + 1:]
        p = sub @ x
        w = 2 * (p - (x @ p) * x)
        sub -= np.outer(x, w) + np.outer(w, x)
    if d > 1:
        off[-1] = a[d - 1, d - 2]
    return np.diag(a).copy(), off


def count_above(tri: tuple[np.ndarray, np.ndarray], s: float) -> int:
    """Eigenvalues above ``s``: the positive pivots of the shifted matrix (Sylvester's law of inertia)."""
    diagonal, off = tri
    tiny = np.finfo(float).tiny ** 0.5
    n, pivot = 0, 1.0
    for k, a in enumerate(diagonal.tolist()):
        pivot = a - s - (off[k - 1] ** 2 / pivot if k else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        n += pivot > 0
    return n


def interval(tri, norm: float, wanted: int) -> tuple[float, float, int]:
    """(low, high, count): ``wanted`` eigenvalues or a few more lie above low, none above high."""
    d = len(tri[0])
    high, low = norm * 1.01, -norm * 1.01
    enough, few = low, high
    for _ in range(60):
        if count_above(tri, enough) <= wanted + max(2, wanted // 2) or few - enough <= 1e-9 * norm:
            break
        middle = (enough + few) / 2
        enough, few = (middle, few) if count_above(tri, middle) >= wanted else (enough, middle)
    return enough, high, count_above(tri, enough) if enough > low else d


# -- contour ---------------------------------------------------------------------------------------

def _solve(matrix, space):
    def run(batches):
        v, y = matrix.value, space.value
        for batch in batches:
            for x, radius, middle, weight in zip(*[batch.column(c).to_pylist() for c in range(4)]):
                # the upper half of the circle; the lower one adds the conjugate
                turn = np.exp(0.5j * np.pi * (x + 1))
                z = middle + radius * turn
                part = 0.5 * weight * (radius * turn * np.linalg.solve(z * np.eye(len(v)) - v, y.astype(complex))).real
                yield pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary())], names=["part"])
    return run


def project(spark: SparkSession, matrix, y: np.ndarray, low: float, high: float, points: int) -> np.ndarray:
    """The sum over the quadrature points, each solved in a task of its own, of the shifted solutions for ``y``."""
    x, weight = np.polynomial.legendre.leggauss(points)
    rows = [(float(a), (high - low) / 2, (high + low) / 2, float(w)) for a, w in zip(x, weight)]
    nodes = spark.createDataFrame(rows, "x double, radius double, middle double, weight double").repartition(points)
    space = spark.sparkContext.broadcast(y)
    parts = arrow_map(nodes, _solve(matrix, space), "part binary").collect()
    space.unpersist()
    return np.sum([np.frombuffer(p.part).reshape(y.shape) for p in parts], axis=0)


def leading(spark: SparkSession, v: np.ndarray, wanted: int, points: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of ``v``, falling, and their unit eigenvectors as columns."""
    d, norm = len(v), float(np.abs(v).sum(axis=1).max(initial=0.0))
    wanted = min(wanted, d)
    if norm == 0 or wanted == 0:
        return np.zeros(wanted), np.eye(d)[:, :wanted]
    v = v / norm
    tri = tridiagonal(v)
    low, high, count = interval(tri, 1.0, wanted)
    size = min(d, 2 * count + 8)
    matrix = spark.sparkContext.broadcast(v)
    rng = np.random.default_rng(d)
    u, before = rng.normal(size=(d, size)), np.inf
    try:
        for _ in range(ROUNDS):
            q = np.linalg.qr(project(spark, matrix, u, low, high, points) if size < d else u)[0]
            q = np.linalg.qr(q)[0]  # once more: the projection leaves nearly dependent columns
            e, s = np.linalg.eigh(q.T @ v @ q)
            e, u = e[::-1], q @ s[:, ::-1]
            inside = e > low
            residual = np.linalg.norm(v @ u - u * e, axis=0)[inside].max(initial=0.0)
            done = residual <= 2e-15 * np.sqrt(d) or residual <= 1e-14 * d and residual > before / 2
            before = residual
            if done and inside.sum() == count:
                return e[:wanted] * norm, u[:, :wanted]
            if done:  # an eigenvalue was missed, or one lies on the border of the interval
                low -= 1e-7
                count, size, points = count_above(tri, low), min(d, 2 * size), 2 * points
                u, before = np.concatenate([u, rng.normal(size=(d, size - u.shape[1]))], axis=1), np.inf
    finally:
        matrix.unpersist()
    raise ArithmeticError(f"contour integration found {int(inside.sum())} components, inertia counts {count}")


# -- moments over the table ------------------------------------------------------------------------

def _matrix(column: pa.Array) -> np.ndarray:
    off = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if off[-1] > off[0] else np.zeros((len(column), 0))


def _chunks(batches):
    """(dimension, first row, rows as a matrix of longs, batch) with equal dimension, at most ``CHUNK`` rows."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for d in np.unique(dims):
            part = batch.filter(pa.array(dims == d))
            size = max(1, min(CHUNK, (8 << 20) // (8 * max(int(d), 1))))
            for a in range(0, part.num_rows, size):
                rows = part.slice(a, size)
                yield int(d), _matrix(rows.column("x")), rows


def _by_row(d: int, m) -> pa.RecordBatch:
    """Rows (dim, i, v) of a matrix."""
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(m), d, np.int32)), pa.array(np.arange(len(m), dtype=np.int32)),
                                       pa.array(list(m), pa.list_(pa.float64()))], names=["dim", "i", "v"])


def _summed(function):
    """An Arrow function: the sums of ``function`` (dimension, rows) over a task, as rows (dim, i, v)."""
    def run(batches):
        held: dict[int, np.ndarray] = {}
        for d, x, _ in _chunks(batches):
            held[d] = held.get(d, 0.0) + np.atleast_2d(function(d, x))
        for d, m in held.items():
            yield _by_row(d, m)
    return run


def _sums(batches):
    """(dim, n, sums as text) of a task, exact."""
    held: dict[int, tuple] = {}
    for d, x, _ in _chunks(batches):
        n, s = held.get(d, (0, 0))
        own = x if np.abs(x.astype(float)).max() < 2 ** 50 else x.astype(object)
        held[d] = n + len(x), s + own.sum(axis=0).astype(object)
    for d, (n, s) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([n]), pa.array([[str(v) for v in s]])], names=["dim", "n", "sums"])


def _added(batches):
    """Sums of the arrays ``v`` of every (dim, i)."""
    held: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for d, i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            held[d, i] = held.get((d, i), 0.0) + v.values.to_numpy()
    for (d, i), v in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([i], pa.int32()), pa.array([v])], names=["dim", "i", "v"])


def _total(fit_list: DataFrame, function) -> dict[int, np.ndarray]:
    """Sums of ``function`` over the fit list by dimension; tasks' partial rows meet by (dim, i), so that only
    whole rows of a matrix reach the driver."""
    parts = arrow_map(fit_list, _summed(function), "dim int, i int, v array<double>")
    out: dict[int, dict[int, list]] = {}
    for r in arrow_map(parts.repartition("dim", "i"), _added, "dim int, i int, v array<double>").collect():
        out.setdefault(r.dim, {})[r.i] = r.v
    return {d: np.array([rows[i] for i in range(len(rows))]) for d, rows in out.items()}


class Fit:
    """Size and exact sums of a fit list; then its components (columns), eigenvalues and shares of variance."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.components = self.values = self.explained = self.white_mean = None
        self.error = 0.0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: as longs where they hold it, else as Python integers."""
        if self.n * float(np.abs(x.astype(float)).max(initial=0)) + max(map(abs, self.sums), default=0) < 2 ** 62:
            return x * self.n - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x).astype(np.float64) / self.n

    def white(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        s = self.scaled(x)
        if x.shape[1] * float(np.abs(s.astype(float)).max(initial=0)) ** 2 >= 2 ** 62:
            s = s.astype(object)
        return [int(v) if v < 2 ** 63 else None for v in (s * s).sum(axis=1)]


def _whitened(fits):
    def run(batches):
        for d, x, rows in _chunks(batches):
            fit = fits.value[d]
            m, k = len(x), len(fit.values)
            if not k:
                continue
            row = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [rows.column("vec_id").take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * k, fit.n, dtype=np.int64)), pa.array(fit.deviation(x), pa.int64()).take(pa.array(row)),
                 pa.array(fit.white(x).ravel()), pa.array(np.tile(fit.explained, m)), pa.array(np.full(m * k, fit.error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def fits(spark: SparkSession, fit_list: DataFrame, components: int) -> dict[int, Fit]:
    """The fit of every vector length in ``fit_list`` (dim, x)."""
    sums = (arrow_map(fit_list, _sums, "dim int, n bigint, sums array<string>").select("dim", "n", F.posexplode("sums"))
            .groupBy("dim", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("col").cast("decimal(38,0)")).alias("s"))
            .orderBy("dim", "pos").collect())
    found: dict[int, Fit] = {}
    for r in sums:
        found.setdefault(r.dim, Fit(r.n, [])).sums.append(int(r.s))

    def total(function):
        held = spark.sparkContext.broadcast(found)
        out = _total(fit_list, lambda d, x: function(held.value[d], x))
        held.unpersist()
        return out

    def products(x):
        return x.T @ x

    for d, m in total(lambda fit, x: products(fit.centred(x))).items():
        fit, v = found[d], (m + m.T) / (2 * found[d].n)
        values, vectors = leading(spark, v, components)
        some = values > NO_VARIANCE * values.max(initial=0.0)
        vectors = vectors[:, some]
        fit.components = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
        fit.values, fit.explained = values[some], values[some] / max(np.trace(v), 1e-300)
    for d, m in total(lambda fit, x: fit.white(x).sum(axis=0)).items():
        found[d].white_mean = m[0] / found[d].n
    for d, m in total(lambda fit, x: products(fit.white(x) - fit.white_mean)).items():
        found[d].error = float(np.abs(m / found[d].n - np.eye(len(m))).max(initial=0.0))
    return found


def whiten(vectors: DataFrame, components: int = 4) -> DataFrame:
    """A row per row of ``vectors`` (vec_id, embedding) and component: vec_id, component (from 1), n, deviation,
    whitened, explained, identity_error."""
    spark = vectors.sparkSession
    x = F.col("embedding").cast("array<double>")
    sound = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = stage(vectors.where(F.coalesce(sound, F.lit(False)))
                 .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * 256.0)).alias("x"),
                         F.size("embedding").alias("dim")), "vectors")
    fit_list = stage(rows.select("dim", "x").distinct(), "fit_list")
    held = spark.sparkContext.broadcast(fits(spark, fit_list, components))
    return arrow_map(rows, _whitened(held), "vec_id bigint, component int, n bigint, deviation bigint, whitened double, "
                                            "explained double, identity_error double")
