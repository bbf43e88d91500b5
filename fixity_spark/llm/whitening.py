"""Whitening of embeddings by the leading principal components, found by contour integration (FEAST).

Sums and the covariance are exact sums of whole numbers, taken by Spark over all rows, so they do not depend on the
order of rows. The eigenvalues above are cut into intervals by counts of negative pivots (inertia) of V - sI. For each
interval a task projects onto its eigenvectors: quadrature of complex shifted solves over a circle around it, then
Rayleigh-Ritz, again and again until residuals are as small as they get; the inertia counts say how many must be found.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixity_spark.llm.common import free_worker, tune

#: Components at most, steps of one unit of an entry, and what is added to keep numbers positive.
COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: Eigenvalues of an interval, points of the quadrature over half of its circle, and rounds at most.
PER_INTERVAL, NODES, ROUNDS = 8, 12, 60
#: Eigenvalues below this share of the largest one are taken as zero: nothing can be divided by their roots.
ZERO = 1e-11

_EXACT = 1 << 53
#: Above this, sums of products of many numbers may exceed a decimal, so they are taken in doubles.
_WIDE = 1 << 44


class Fit(NamedTuple):
    n: int
    centre: np.ndarray  #: nearest whole number to each mean
    off: np.ndarray  #: sum minus n * centre, whole numbers
    values: np.ndarray  #: eigenvalues, falling
    vectors: np.ndarray  #: a column each
    total: float  #: trace of the covariance


def _numbers(column: pa.Array, dims: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of usable vectors and their entries as whole numbers (rows x dims).

    Usable: of dims entries, none null, not finite or too large for a long.
    """
    column = column.cast(pa.list_(pa.float64())) if not pa.types.is_list(column.type) or column.type.value_type != pa.float64() else column
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dims) if dims else np.zeros(0, np.int64)
    if not len(rows):
        return rows, np.zeros((0, dims or 0), np.int64)
    flat = column.take(pa.array(rows)).flatten()
    x = np.floor(flat.to_numpy(zero_copy_only=False).reshape(len(rows), dims) * SCALE)  # nulls come as NaN
    good = (np.isfinite(x) & (np.abs(x) < 2.0**61)).all(axis=1)
    return rows[good], x[good].astype(np.int64) + SHIFT


def _scatter(y: np.ndarray) -> np.ndarray:
    """Exact y.T @ y of whole numbers: in doubles as long as no sum of products can exceed 2**53."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    most = int(np.abs(y).max(initial=0)) ** 2
    if most >= _EXACT:
        y = y.astype(object)
        return total + y.T @ y
    step = max(1, min(len(y), _EXACT // max(most, 1)))
    for k in range(0, len(y), step):
        part = y[k : k + step].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def _sums(dims: int):
    """For each task the number of usable vectors (dim -1), of those with very large entries (-2), and the sum of each
    dimension."""

    def run(batches):
        free_worker()
        n, wide, total = 0, 0, np.zeros(dims, object)
        for b in batches:
            rows, x = _numbers(b.column(0), dims)
            if len(rows):
                n += len(rows)
                most = np.abs(x).max(axis=1)
                wide += int((most >= _WIDE).sum())
                total += (x if int(most.max()) * len(x) < 2**62 else x.astype(object)).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(-2, dims), pa.int64()), pa.array([wide, n, *map(int, total)], pa.decimal128(38, 0))], ["k", "s"])

    return run


def _products(dims: int, centre: np.ndarray, exact: bool):
    """For each task the sums of products of each pair of dimensions, i <= j, at i * dims + j."""
    upper = np.triu_indices(dims)

    def run(batches):
        free_worker()
        total = np.zeros((dims, dims), object if exact else float)
        for b in batches:
            y = _numbers(b.column(0), dims)[1] - centre
            total += _scatter(y) if exact else y.astype(float).T @ y.astype(float)
        sums = pa.array([int(v) for v in total[upper]], pa.decimal128(38, 0)) if exact else pa.array(total[upper])
        yield pa.RecordBatch.from_arrays([pa.array(upper[0] * dims + upper[1], pa.int64()), sums], ["k", "s"])

    return run


def negative_pivots(a: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are negative: pivots of its factorisation, of one row or of two, each
    chosen among all that are left (Sylvester's law of inertia)."""
    a, count = a.copy(), 0
    while n := len(a):
        diag = np.abs(np.diag(a))
        off = np.abs(a - np.diag(np.diag(a)))
        i, (r, s) = int(diag.argmax()), divmod(int(off.argmax()), n)
        if diag[i] >= 0.6404 * off[r, s]:
            if diag[i] == 0:
                return count
            rest = np.delete(np.arange(n), i)
            count += int(a[i, i] < 0)
            a = a[np.ix_(rest, rest)] - np.outer(a[rest, i], a[i, rest]) / a[i, i]
        else:
            pair, rest = [r, s], np.delete(np.arange(n), [r, s])
            count += 1  # such a pair of rows has one eigenvalue of each sign
            a = a[np.ix_(rest, rest)] - a[np.ix_(rest, pair)] @ np.linalg.solve(a[np.ix_(pair, pair)], a[np.ix_(pair, rest)])
        a = (a + a.T) / 2
    return count


def _cut(below, low: float, high: float) -> tuple[float, int]:
    """A place to cut at and the eigenvalues below it, with as much room free of eigenvalues around it as can be had."""
    for free in (1e-2, 1e-3, 1e-5):  # of the width, on both sides
        for at in (0.5, 0.45, 0.55, 0.4, 0.6, 0.35, 0.65, 0.3, 0.7):
            s = low + at * (high - low)
            if (n := below(s - free * (high - low))) == below(s + free * (high - low)):
                return s, n
    return (low + high) / 2, below((low + high) / 2)


def intervals(v: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside), from the top down, until wanted ones are inside; cuts keep away from eigenvalues."""
    eye = np.eye(len(v))
    below = lambda s: negative_pivots(v - s * eye)
    top = float(np.abs(v).sum(axis=1).max()) * 1.01  # no eigenvalue is above the largest row sum
    out, found = [], 0
    work = [(-0.01 * top, top, 0, len(v))]
    while work and found < wanted:
        low, high, n_low, n_high = work.pop()
        n = n_high - n_low
        if not n:
            continue
        if n <= PER_INTERVAL or high - low <= 1e-10 * top:
            out.append((low, high, n))
            found += n
            continue
        cut, n_cut = _cut(below, low, high)
        work += [(low, cut, n_low, n_cut), (cut, high, n_cut, n_high)]
    return out


def contour_eigenpairs(v: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The count eigenvalues of v in (low, high), rising, with their eigenvectors; fails where they are not all found."""
    n = len(v)
    scale = float(np.abs(v).sum(axis=1).max()) or 1.0
    t, w = np.polynomial.legendre.leggauss(NODES)
    angle = np.pi / 2 * (1 - t)  # the lower half of the circle gives the complex conjugates
    centre, radius = (low + high) / 2, (high - low) / 2
    turn = radius * np.exp(1j * angle)
    y = np.random.default_rng(20240229).standard_normal((n, min(n, count + max(4, count // 2))))
    best, since = np.inf, 0
    for _ in range(ROUNDS):
        z = sum(0.5 * w[k] * np.real(turn[k] * np.linalg.solve((centre + turn[k]) * np.eye(n) - v, y)) for k in range(NODES))
        basis, sizes, _ = np.linalg.svd(z, full_matrices=False)
        basis = basis[:, sizes > 1e-14 * sizes[0]]
        values, coords = np.linalg.eigh(basis.T @ v @ basis)
        y = basis @ coords
        inside = (values > low) & (values < high)
        residual = np.linalg.norm(v @ y[:, inside] - y[:, inside] * values[inside], axis=0).max(initial=0.0) / scale
        since = 0 if residual < best / 2 else since + 1
        best = min(best, residual)
        if inside.sum() == count and (residual <= 4e-16 or best <= 1e-12 and since >= 2):
            return values[inside], y[:, inside]
    raise ArithmeticError(f"{int(inside.sum())} of {count} eigenvalues between {low} and {high}, residual {residual}")


def leading_components(spark: SparkSession, v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of v, falling, and their eigenvectors: each interval is a task, as none needs another.

    A last Rayleigh-Ritz step over all of them makes those of neighbouring intervals orthogonal.
    """
    cuts = intervals(v, wanted)
    held = spark.sparkContext.broadcast(v)  # dims * dims doubles

    def solve(batches):
        for b in batches:
            for low, high, count in zip(*(c.to_pylist() for c in b.columns), strict=True):
                values, vectors = contour_eigenpairs(held.value, low, high, count)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(list(vectors.T), pa.list_(pa.float64()))], ["value", "vector"])

    rows = spark.createDataFrame(cuts, "low double, high double, n int").repartition(len(cuts)).mapInArrow(solve, "value double, vector array<double>").collect()
    vectors = np.array([r.vector for r in sorted(rows, key=lambda r: -r.value)]).T
    basis = np.linalg.qr(vectors)[0]
    values, coords = np.linalg.eigh(basis.T @ v @ basis)
    values, vectors = values[::-1][:wanted], (basis @ coords)[:, ::-1][:, :wanted]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * sign


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Fit | None:
    """Sums, covariance and leading components of all usable vectors; None where there is none."""
    spark = vectors.sparkSession
    data = vectors.select(F.col(column).cast("array<double>").alias("v"))
    sizes = data.where("size(v) > 0").groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return None
    dims = sizes.d

    def total(task, kind: str) -> dict:
        rows = data.mapInArrow(task, f"k long, s {kind}").groupBy("k").agg(F.sum("s").cast(kind).alias("s"))
        return {r.k: r.s for r in rows.toLocalIterator()}

    whole = "decimal(38,0)"
    sums = {k: int(x) for k, x in total(_sums(dims), whole).items()}
    n, wide = sums.pop(-1, 0), sums.pop(-2, 0)
    if not n:
        return None
    s = [sums[k] for k in range(dims)]
    centre = np.array([(2 * x + n) // (2 * n) for x in s], np.int64)
    off = np.array([x - n * int(c) for x, c in zip(s, centre, strict=True)], object)
    products = total(_products(dims, centre, not wide), "double" if wide else whole)
    v = np.zeros((dims, dims))
    for k, p in products.items():
        i, j = divmod(k, dims)
        v[i, j] = v[j, i] = p / n - (off[i] / n) * (off[j] / n) if wide else (n * int(p) - int(off[i] * off[j])) / (n * n)  # rounded once
    trace = float(np.trace(v))
    if trace <= 0:
        return Fit(n, centre, off, np.zeros(0), np.zeros((dims, 0)), trace)
    values, u = leading_components(spark, v, min(components, dims))
    real = values > ZERO * values[0]
    return Fit(n, centre, off, values[real], u[:, real], trace)


def _whitened(x: np.ndarray, f: Fit) -> np.ndarray:
    return ((x - f.centre) - (f.off / f.n).astype(np.float64)) @ (f.vectors / np.sqrt(f.values))


def _moments(column_dims: int, held):
    """For each task the sums of whitened components (j = -1) and of their products, i <= j."""

    def run(batches):
        free_worker()
        f = held.value
        k = len(f.values)
        first, second = np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = _whitened(_numbers(b.column(0), column_dims)[1], f)
            first += w.sum(axis=0)
            second += w.T @ w
        upper = np.triu_indices(k)
        i, j = np.concatenate([np.arange(k), upper[0]]), np.concatenate([np.full(k, -1), upper[1]])
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.concatenate([first, second[upper]]))], ["i", "j", "s"])

    return run


def _deviations(x: np.ndarray, f: Fit) -> pa.Array:
    """Sum over dimensions of (n x - S)^2, exact; null where it is too large for a long."""
    y = x - f.centre
    most = f.n * int(np.abs(y).max(initial=0)) + max(abs(int(o)) for o in f.off)
    if x.shape[1] * most * most < 2**63:
        z = f.n * y - f.off.astype(np.int64)
        return pa.array((z * z).sum(axis=1), pa.int64())
    z = f.n * y.astype(object) - f.off
    return pa.array([int(d) if d < 2**63 else None for d in (z * z).sum(axis=1)], pa.int64())


def whiten(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty or hold null, infinite or NaN entries are left out, and so are entries of 2**55 and
    more and vectors of another length than most have (of equally many, the longer). An entry c counts as floor(64 c) +
    1000000. Components are numbered by falling eigenvalue of the covariance (divisor n); at most 32, and none whose
    eigenvalue is below 1e-11 of the largest: where all vectors are equal nothing is returned. The largest entry of each
    eigenvector is positive. deviation is exact, null where a long cannot hold it. identity_error is the largest entry
    of the whitened covariance minus the identity, over all rows. Rows repeated with one id get rows each; other columns
    are not read. Every pass reads the vectors alone; only sums of a task are shuffled, dims * dims of them at most, and
    the driver holds one such matrix.
    """
    spark = vectors.sparkSession
    tune(spark)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    f = fit(vectors, column, components)
    if f is None or not len(f.values):
        return spark.createDataFrame([], schema)
    dims, k = len(f.centre), len(f.values)
    held = spark.sparkContext.broadcast(f)
    data = vectors.select(F.col(column).cast("array<double>").alias("v"), F.col(key).cast("long").alias("vec_id"))
    moments = np.zeros((k, k))
    mean = np.zeros(k)
    for r in data.select("v").mapInArrow(_moments(dims, held), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():  # k * (k + 3) / 2 rows
        if r.j < 0:
            mean[r.i] = r.s / f.n
        else:
            moments[r.i, r.j] = moments[r.j, r.i] = r.s / f.n
    # whitened components are centred before they are multiplied; what rounding left of their mean goes, too
    error = float(np.abs(moments - np.outer(mean, mean) - np.eye(k)).max())
    explained = f.values / f.total

    def score(batches):
        free_worker()
        f = held.value
        for b in batches:
            rows, x = _numbers(b.column(0), dims)
            if not len(rows):
                continue
            each = pa.array(np.repeat(np.arange(len(rows)), k))
            m = len(rows) * k
            columns = [b.column(1).take(pa.array(rows)).take(each), pa.array(np.tile(np.arange(1, k + 1), len(rows)), pa.int32()), pa.array(np.full(m, f.n), pa.int64()), _deviations(x, f).take(each), pa.array(_whitened(x, f).ravel()), pa.array(np.tile(explained, len(rows))), pa.array(np.full(m, error))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return data.mapInArrow(score, schema)
