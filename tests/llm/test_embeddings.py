import numpy as np
import pytest
from pyspark.sql import functions as F

from fixity_spark.llm import embeddings
from fixity_spark.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=embeddings.COSINE):
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    good = [i for i, (v, e, k) in enumerate(rows) if v is not None and k is not None and e and None not in e and np.isfinite(e).all() and any(e)]
    x = {i: np.float32(rows[i][1]).astype(float) / np.linalg.norm(np.float32(rows[i][1]).astype(float)) for i in good}
    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(x[a]) == len(x[b]) and x[a] @ x[b] >= least:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    low = {}
    for i, (v, _, _) in enumerate(rows):
        if v is not None:
            low[root(i)] = min(low.get(root(i), v), v)
    return sorted(((v, links[i], low.get(root(i)), v == low.get(root(i))) for i, (v, _, _) in enumerate(rows)), key=str)


def clustered(n, seed, spread=0.05, dim=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 8), dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dim)) * spread / np.sqrt(dim) * 8
    return x.astype(np.float32)


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)) * 2
    p = embeddings.nearest_e8(x)
    assert (np.abs(2 * p - np.rint(2 * p)) < 1e-9).all() and (p.sum(1) % 2 == 0).all()
    own = ((x - p) ** 2).sum(1)
    for r in embeddings.roots():
        assert (((x - p - r) ** 2).sum(1) >= own - 1e-9).all()


def test_messy_vectors(spark):
    v = [float(i % 5) for i in range(64)]
    rows = [(1, v, 1), (2, [2 * x for x in v], 1), (2, [2 * x for x in v], 1), (3, v, 2), (4, None, 1), (5, [], 1), (6, [0.0] * 64, 1), (7, [float("nan")] * 64, 1), (8, [None, *v[1:]], 1), (9, v, None), (None, v, 1), (10, [float("inf"), *v[1:]], 1), (11, v[:8], 1), (12, v[:8], 1), (13, [1.0], 1), (14, [3.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in embeddings.near_duplicates(df.selectExpr("*", "1 AS id", "2 AS cell", "3 AS n")).collect()), key=str)
    want = sorted(((None, 0, None, True) if r[0] is None else r for r in brute(rows)), key=str)
    assert got == want
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_equal_to_brute_force_where_clear(spark):
    rows = [(i, [float(y) for y in x], i % 3) for i, x in enumerate(clustered(600, 1, 0.02))]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_recall_near_the_threshold(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        b = rng.normal(size=64)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = 0.932 + 0.03 * rng.random()
        rows += [(2 * i, [float(x) for x in a], 0), (2 * i + 1, [float(x) for x in c * a + np.sqrt(1 - c * c) * b], 0)]
    found = sum(r.n_links for r in embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found >= 0.9 * sum(r[1] for r in brute(rows))
    assert found <= sum(r[1] for r in brute(rows))


@pytest.mark.parametrize("cell", [8, 64])
def test_full_cells_are_cut(spark, monkeypatch, cell):
    monkeypatch.setattr(embeddings, "CELL", cell)
    rng = np.random.default_rng(7)
    one = rng.normal(size=64)
    rows = [(i, [float(x) for x in one + rng.normal(size=64) * (0.2 if i % 2 else 0.01)], 1) for i in range(150)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute(rows)
    assert sum(r.n_links for r in got) >= 0.97 * sum(r[1] for r in want)
    assert {r.component_id for r in got} == {r[2] for r in want}


def test_askers_are_cut_as_own_rows_are(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL", 64)
    # cell 1: askers only; 2: three own rows; 3: many of both; 4: as it is
    held = {1: (0, 3000), 2: (3, 3000), 3: (500, 3000), 4: (10, 20)}
    raw = [(cell, 10_000 * cell + i, int(i >= own)) for cell, (own, asks) in held.items() for i in range(own + asks)]
    rows = spark.createDataFrame(raw, embeddings._ROW)
    got = embeddings._meetings(rows, Scratch(spark, "test")).groupBy("cell", "part", "ask").agg(F.count_if(F.col("role") == 0).alias("own"), F.count_if(F.col("role") != 0).alias("asks"))
    got = got.collect()
    assert {r.cell for r in got} == {2, 3, 4}
    assert max(r.own for r in got) <= 128 and max(r.asks for r in got) <= 128
    whole = {c: (sum(r.own for r in got if r.cell == c and r.ask <= 0), sum(r.asks for r in got if r.cell == c and r.part <= 0)) for c in (2, 3, 4)}
    assert whole == {2: (3, 3003), 3: (500, 3500), 4: (10, 20)}


def test_tight_cluster_of_distinct_vectors(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL", 16)
    rng = np.random.default_rng(11)
    one = rng.normal(size=64)
    rows = [(i, [float(x) for x in one + rng.normal(size=64) * 1e-4], 1) for i in range(200)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_double_vectors(spark):
    rows = [(1, [1.0, 2.0, 3.0] * 8, 1), (2, [1.0, 2.0, 3.001] * 8, 1)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.component_id for r in got} == {1}


def test_recall_on_the_table(spark):
    """Links found of those there are; vectors of a label are compared all with all, in blocks of rows."""
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    found = sum(r.n_links for r in embeddings.near_duplicates(table).collect())
    there = 0
    for _, rows in table.where("label IS NOT NULL").toPandas().groupby("label"):
        x = np.stack(rows["embedding"].to_numpy()).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        there += int(sum((x[i : i + 1000] @ x.T >= embeddings.COSINE).sum() for i in range(0, len(x), 1000))) - len(x)
    assert 0.97 * there <= found <= there, (found, there)
