"""Near-duplicate embeddings by E8 lattice hashing, verified by cosine."""

from __future__ import annotations

import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixity_spark.llm.common import Scratch, components

#: Tables, E8 points in a cell's name, neighbouring points probed for each of them, and lattice units that a
#: unit vector of 64 dimensions spans. At cosine 0.93 these find 98.5 % of random pairs, above it more.
TABLES, POINTS, PROBES, SPREAD = 6, 2, 2, 3.5
COSINE = 0.93
#: Index rows of a cell, its own and those that probe it, compared in one step; a fuller cell is cut into blocks
#: that meet pair by pair.
CELL = 1024
#: Pairs whose cosine is taken at once.
PAIRS = 50_000
#: Rows of a bucket of cells, about.
BUCKET = 20_000


@functools.cache
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = s, t
            out.append(v)
    out += [list(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The E8 point nearest to each row: the better of the nearest in D8 and in D8 shifted by one half."""

    def d8(y):
        near = np.rint(y)
        rest = y - near
        odd = np.flatnonzero(near.sum(1) % 2 != 0)
        k = np.abs(rest[odd]).argmax(1)
        near[odd, k] += np.where(rest[odd, k] >= 0, 1.0, -1.0)
        return near

    whole, half = d8(x), d8(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


@functools.cache
def _projection(dim: int, table: int) -> np.ndarray:
    rng = np.random.default_rng((dim, table, 8))
    m = rng.normal(size=(dim, 8 * POINTS))
    m = np.linalg.qr(m)[0] if dim >= 8 * POINTS else m / np.sqrt(dim)
    return m * SPREAD * np.sqrt(dim / 64)


_MIX = np.random.default_rng(8).integers(1, 2**62, size=(64, 8 * POINTS), dtype=np.int64) | 1


def cells(x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
    """Own cell of each unit vector (rows) and the cells it probes (rows x POINTS * PROBES), as 64-bit names."""
    y = x @ _projection(x.shape[1], table)
    w = _MIX[table % 64]
    own = np.full(len(x), np.int64(table * 1_000_003 + x.shape[1]))
    steps = []
    with np.errstate(over="ignore"):
        for k in range(POINTS):
            part, weights = y[:, 8 * k : 8 * k + 8], w[8 * k : 8 * k + 8]
            point = nearest_e8(part)
            own = own + (np.rint(2 * point).astype(np.int64) * weights).sum(1)
            # the neighbours whose cells lie closest are those along the rest
            best = np.argpartition(-((part - point) @ roots().T), PROBES, axis=1)[:, :PROBES]
            steps.append((np.rint(2 * roots()).astype(np.int64) * weights).sum(1)[best])
        return own, own[:, None] + np.concatenate(steps, 1)


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


#: A row of the index: mark is twice the table, and one more where the vector probes the cell.
_ROW = "cell long, id long, mark int"


def _fingerprints(wide: bool):
    def mark(batches):
        for b in batches:
            ids, labels, vectors = b.column(0), b.column(1).to_pylist(), b.column(2)
            prints, payloads = [], []
            flat = np.asarray(vectors.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False), np.float64 if wide else np.float32)
            at = 0
            for i, size in enumerate(np.diff(vectors.offsets.to_numpy()).tolist()):
                own = flat[at : at + size]
                missing = not vectors[i].is_valid
                at += 0 if missing else size
                if missing or labels[i] is None or not size or not np.isfinite(own).all() or not own.any() or ids[i].as_py() is None:
                    prints.append(None)
                    payloads.append(None)
                else:
                    payloads.append(own.tobytes())
                    prints.append(hashlib.blake2b(repr(labels[i]).encode() + b"|" + payloads[-1], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([ids, pa.array([None if x is None else str(x) for x in labels], pa.string()), pa.array(prints, pa.binary()), pa.array(payloads, pa.binary())], ["_fx_id", "_fx_label", "_fx_print", "_fx_vec"])

    return mark


def _index(wide: bool):
    kind = np.float64 if wide else np.float32

    def index(batches):
        for b in batches:
            ids, labels, payloads = b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()
            sizes = np.array([len(p) for p in payloads])
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                x = unit(np.frombuffer(b"".join(payloads[i] for i in rows), kind).reshape(len(rows), -1))
                salt = np.array([int.from_bytes(hashlib.blake2b(labels[i].encode(), digest_size=8).digest(), "little", signed=True) for i in rows], np.int64)
                for t in range(TABLES):
                    own, near = cells(x, t)
                    names = np.concatenate([own[:, None], near], 1) + salt[:, None]
                    n, width = names.shape
                    mark = 2 * t + np.tile(np.arange(width) > 0, n)
                    yield pa.RecordBatch.from_arrays([pa.array(names.reshape(-1)), ids.take(pa.array(np.repeat(rows, width))), pa.array(mark.astype(np.int32))], ["cell", "id", "mark"])

    return index


def _first_meeting(own: np.ndarray, near: np.ndarray, table: int, i: np.ndarray, j: np.ndarray, at_own: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether the cell at hand is the one where pair (i, j) counts: the first table, and one cell in it.

    own: tables x rows; near: tables x rows x probes. i is in its own cell; at_own tells whether j is, too.
    """
    keep = np.ones(len(i), bool)
    for t in range(table):
        keep &= ~((own[t, i] == own[t, j]) | (near[t, i] == own[t, j][:, None]).any(1) | (near[t, j] == own[t, i][:, None]).any(1))
    same = own[table, i] == own[table, j]
    mutual = (near[table, i] == own[table, j][:, None]).any(1)
    return keep & np.where(at_own, True, ~same & ((ids[i] < ids[j]) | ~mutual))


def _linked(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether the cosine of rows a of x and b of y reaches least; blocks of a cut cell have a million such pairs."""
    ok = np.zeros(len(a), bool)
    for k in range(0, len(a), PAIRS):
        ok[k : k + PAIRS] = (x[a[k : k + PAIRS]] * y[b[k : k + PAIRS]]).sum(1) >= least
    return ok


def _compare(least: float, wide: bool):
    kind = np.float64 if wide else np.float32

    def links(table: pa.Table) -> tuple[dict[int, int], list[tuple[int, int]]]:
        """Weighted link counts of the rows of one bucket, and edges that span its linked groups."""
        cell, role, part, ask, tbl, ids, n = (table[c].to_numpy() for c in ("cell", "role", "part", "ask", "tbl", "id", "n"))
        x = unit(np.frombuffer(b"".join(table["vec"].to_pylist()), kind).reshape(len(ids), -1))
        order = np.lexsort((ids, role, ask, part, tbl, cell))  # a bucket holds several cells
        head = np.append(True, np.any([np.diff(v[order]) != 0 for v in (cell, tbl, part, ask)], axis=0))
        begin = np.flatnonzero(head)
        size = np.diff(np.append(begin, len(order)))
        counts: dict[int, int] = {}
        edges: list[tuple[int, int]] = []
        for at, m in zip(begin.tolist(), size.tolist(), strict=True):
            if m < 2 or role[order[at]] != 0:
                continue
            rows = order[at : at + m]
            own = int((role[rows] == 0).sum())  # sorted by role: the cell's own rows come first
            a, b = np.nonzero(x[rows[:own]] @ x[rows].T >= least - 1e-9)
            of, who = role[rows], ids[rows]
            ok = np.where(of[b] == 2, who[a] != who[b], (who[a] < who[b]) & ((of[b] == 1) | (part[rows[0]] < 0)))
            a, b = a[ok], b[ok]
            ok = _linked(x, x, rows[a], rows[b], least)
            a, b = a[ok], b[ok]
            if not len(a):
                continue
            used, back = np.unique(np.concatenate([a, b]), return_inverse=True)
            i, j = back[: len(a)], back[len(a) :]
            names = [cells(x[rows[used]], t) for t in range(int(tbl[rows[0]]) + 1)]
            who, weight = who[used], n[rows[used]]
            first = _first_meeting(np.stack([c[0] for c in names]), np.stack([c[1] for c in names]), len(names) - 1, i, j, of[b] != 2, who)
            i, j = i[first], j[first]
            got = np.bincount(i, weight[j], len(used)) + np.bincount(j, weight[i], len(used))
            for k in np.flatnonzero(got).tolist():
                counts[int(who[k])] = counts.get(int(who[k]), 0) + int(got[k])
            root = np.arange(len(used))
            while True:  # the first of each group, by passing it along the links
                low = root.copy()
                np.minimum.at(low, i, root[j])
                np.minimum.at(low, j, root[i])
                low = low[low]
                if (low == root).all():
                    break
                root = low
            edges += [(int(who[k]), int(who[root[k]])) for k in np.flatnonzero(root != np.arange(len(used))).tolist()]
        return counts, edges

    def compare(table: pa.Table) -> pa.Table:
        counts: dict[int, int] = {}
        edges: list[tuple[int, int]] = []
        dims = pc.binary_length(table["vec"]).to_numpy()
        for dim in np.unique(dims):
            more, found = links(table.filter(pa.array(dims == dim)))
            for k, v in more.items():
                counts[k] = counts.get(k, 0) + v
            edges += found
        return pa.table({"counted": pa.array([True] * len(counts) + [False] * len(edges), pa.bool_()), "a": pa.array([*counts, *(e[0] for e in edges)], pa.int64()), "b": pa.array([*counts.values(), *(e[1] for e in edges)], pa.int64())})

    return compare


def _meetings(index: DataFrame, scratch: Scratch) -> DataFrame:
    """Who meets where: (cell, tbl, id, role, part, ask), role 0 for a row of its own cell, 2 for one that probes it.

    Only cells with an own row and another one stay, and no vector travels before that is known. Cells of more than
    CELL rows, own and probing, are cut into blocks of both, and each block of own rows meets each block of askers,
    which are all its rows; role 1 is an own row that asks. So no step compares more than about CELL rows with CELL.
    """
    held = index.groupBy("cell").agg(F.count_if(F.col("mark") % 2 == 0).alias("own"), F.count("*").alias("c")).where("own > 0 AND c > 1")
    blocks = lambda n: F.expr(f"cast(({n} + {CELL - 1}) div {CELL} AS int)")
    held = scratch.write(held.select("cell", blocks("own").alias("own_blocks"), blocks("c").alias("ask_blocks")), "cells")
    rows = index.join(held, "cell")
    own, every = F.expr("mark % 2 = 0"), lambda blocks: F.sequence(F.lit(0), F.col(blocks) - 1)
    block = lambda salt, blocks: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(blocks)).cast("int")
    spot = lambda role, part, ask: F.struct(role.cast("int").alias("role"), part.cast("int").alias("part"), ask.cast("int").alias("ask"))
    whole = F.array(spot(F.when(own, 0).otherwise(2), F.lit(-1), F.lit(-1)))
    asks = F.transform(every("own_blocks"), lambda p: spot(F.when(own, 1).otherwise(2), p, block("ask", "ask_blocks")))
    answers = F.transform(every("ask_blocks"), lambda a: spot(F.lit(0), block("own", "own_blocks"), a))
    dealt = F.when(F.col("ask_blocks") == 1, whole).when(own, F.concat(answers, asks)).otherwise(asks)
    return rows.select("cell", F.expr("mark div 2").cast("int").alias("tbl"), "id", F.inline(dealt))


def near_duplicates(vectors: DataFrame, least: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of vectors: id, n_links, component_id, kept.

    Vectors with equal labels and dimensions link when their cosine in double precision is at least least.
    Candidates come from TABLES hash tables: a vector is projected to POINTS x 8 dimensions, each part is decoded to its
    nearest E8 lattice point, and the points name a cell; a vector is compared with those of its own cell and
    of PROBES neighbouring cells for each point. Equal vectors are collapsed first and count with their number. A pair
    counts only where it meets first, so links are summed without being listed. Recall is below 1 by design:
    about 0.985 at cosine 0.93, rising to 1.

    A vector that is null, empty, all zero, or holds null or non-finite numbers, or whose label or id is null,
    links with nothing: n_links 0, component its id, kept. Rows repeated with the same id and vector are equal
    vectors, and other to each other. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "lattice")
    element = vectors.schema[vector_col].dataType.elementType
    wide = not isinstance(element, T.FloatType)
    plain = vectors.select(F.col(id_col).cast("long").alias("_fx_id"), F.col(label_col).cast("string").alias("_fx_label"), F.col(vector_col).cast("array<double>" if wide else "array<float>").alias("_fx_v"))
    marked = scratch.write(plain.mapInArrow(_fingerprints(wide), "_fx_id long, _fx_label string, _fx_print binary, _fx_vec binary"), "marked")
    groups = marked.where("_fx_print IS NOT NULL").groupBy("_fx_print").agg(F.min("_fx_id").alias("id"), F.any_value("_fx_label").alias("label"), F.count("*").alias("n"), F.any_value("_fx_vec").alias("vec"))
    groups = scratch.write(groups, "groups")
    total = groups.count()
    narrow = groups.select("id", "label", "vec").repartition(max(1, min(total // 500, 4 * spark.sparkContext.defaultParallelism) or 1, total // 200_000))
    index = scratch.write(narrow.mapInArrow(_index(wide), _ROW), "index")
    met = scratch.write(_meetings(index, scratch), "met")
    scratch.drop("index")
    rows = met.count()
    buckets = max(1, min(1024, rows // 200), rows // BUCKET)
    dealt = met.join(groups.select("id", "n", "vec"), "id").withColumn("bucket", F.pmod(F.xxhash64("cell", "part", "ask"), F.lit(buckets)).cast("int"))
    found = scratch.write(dealt.groupBy("bucket").applyInArrow(_compare(least, wide), "counted boolean, a long, b long"), "found")
    scratch.drop("met")
    scratch.tidy()
    linked = found.where("counted").groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("links"))
    joined = components(found.where("NOT counted").select("a", "b"), scratch)
    summary = groups.select("_fx_print", "id", "n").join(linked, "id", "left").join(joined.withColumnRenamed("node", "id"), "id", "left")
    summary = scratch.write(summary.select("_fx_print", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "summary")
    out = marked.select("_fx_id", "_fx_print").join(summary, "_fx_print", "left")
    component = F.coalesce("component_id", "_fx_id")
    return out.select(F.col("_fx_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("_fx_id").eqNullSafe(component).alias("kept"))


ORACLE_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, least(e.vec_id, coalesce(low.b, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(low.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN degree d ON e.vec_id = d.a LEFT JOIN low ON e.vec_id = low.a
"""
