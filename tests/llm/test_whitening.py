import math

import numpy as np
import pytest

from fixity_spark.llm import whitening


def brute(rows, components=32):
    """(vec_id, deviation, whitened) rows by numpy's own eigenvectors, and explained shares."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[c - t / n for c, t in zip(r, s, strict=True)] for r in x])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    w = centred @ u / np.sqrt(e)
    return [(i, sum((n * c - t) ** 2 for c, t in zip(r, s, strict=True))) for (i, _), r in zip(good, x, strict=True)], w, e / np.trace(centred.T @ centred / n), n


def check(spark, rows, components=32):
    got = sorted(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), components=components).collect(), key=lambda r: (r.vec_id, r.component))
    want, w, explained, n = brute(rows, components)
    order = np.argsort([i for i, _ in want], kind="stable")
    k = len(explained)
    assert len(got) == n * k
    table = np.array([r.whitened for r in got]).reshape(n, k)
    for c in range(k):
        sign = np.sign(np.dot(table[:, c], w[order, c]))
        assert np.allclose(table[:, c], sign * w[order, c], atol=1e-7), c
    assert [(r.vec_id, r.deviation) for r in got[::k]] == [want[i] for i in order]
    assert np.allclose([r.explained for r in got[:k]], explained, rtol=1e-10)
    assert [r.component for r in got[:k]] == list(range(1, k + 1)) and {r.n for r in got} == {n}
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and 0 <= errors.pop() < 1e-9


@pytest.mark.parametrize("dims", [2, 5, 40])
def test_equals_dense_eigenvectors(spark, dims):
    rng = np.random.default_rng(dims)
    x = (rng.standard_normal((300, dims)) * np.geomspace(3, 0.2, dims)) @ rng.standard_normal((dims, dims)) + 5
    check(spark, [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)])


def test_embeddings(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    check(spark, rows)


def matrix(values, seed=1):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    a = (q * np.array(values)) @ q.T
    return (a + a.T) / 2


@pytest.mark.parametrize("values", [[3, 2, 1, -1, -2, 0.5], [1.0] * 5 + [-1.0] * 5, list(np.geomspace(1, 1e-9, 30))])
def test_inertia(values):
    a = matrix(values)
    for s in (-3, -1.5, -0.1, 0.3, 0.9, 1.5, 10):
        assert whitening.negative_pivots(a - s * np.eye(len(a))) == sum(v < s for v in values)
    assert whitening.negative_pivots(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1


@pytest.mark.parametrize("values", [list(range(1, 65)), [5.0] * 20 + list(np.linspace(1, 2, 30)), list(np.geomspace(1, 1e-9, 40)), [1, 1 + 1e-9, 1 + 2e-9] * 5 + [0.5] * 7 + [1e-3] * 9, [7.0, 0, 0, 0]])
def test_contours_find_every_eigenvalue(spark, values):
    a = matrix(values)
    wanted = min(32, len(values))
    e, u = whitening.leading_components(spark, a, wanted)
    true = np.sort(values)[::-1][:wanted]
    assert np.allclose(e, true, atol=1e-13 * max(values))
    assert np.abs(u.T @ u - np.eye(wanted)).max() < 1e-12
    assert np.abs(a @ u - u * e).max() < 1e-12 * max(values)
    assert sum(n for _, _, n in whitening.intervals(a, len(a))) == len(a)


def test_missed_eigenvalues_are_an_error():
    with pytest.raises(ArithmeticError):
        whitening.contour_eigenpairs(matrix([1, 2, 3, 4, 5]), 1.5, 3.5, 3)


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.standard_normal(4)]) for i in range(50)]
    odd = [(100, None), (101, [1.0, None, 0.0, 0.0]), (102, [float("nan"), 0.0, 0.0, 0.0]), (103, [float("inf"), 0.0, 0.0, 0.0]), (104, []), (105, [1.0, 2.0]), (3, rows[3][1]), (None, rows[4][1]), (106, [1e30, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, n int, component string")
    got = whitening.whiten(df).collect()
    assert len(got) == 52 * 4 and {r.n for r in got} == {52}
    assert sorted({(r.vec_id is None, r.vec_id) for r in got}, key=str) == sorted({*((False, i) for i in range(50)), (True, None)}, key=str)
    assert whitening.whiten(df.limit(0)).collect() == []
    assert whitening.whiten(df.where("vec_id = 5")).collect() == []  # nothing varies
    assert whitening.whiten(df.where("vec_id = 100")).collect() == []


def test_flat_directions_have_no_component(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-300, 300, (80, 3)) / 64
    rows = [(i, [float(a), float(b), float(c), float(a), 1.0]) for i, (a, b, c) in enumerate(base)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1, 2, 3} and max(r.identity_error for r in got) < 1e-9


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float((i * 7919) % 1013) * 2.0**20, float(i)]) for i in range(30)]
    rows.append((99, [2.0**50, 1.0]))
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = {i: d if d < 2**63 else None for i, d in brute(rows, 2)[0]}
    assert got == want and None in got.values()
