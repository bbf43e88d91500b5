"""J1, J2 between regions: what two listings do not share, from tables as large as the difference.

Each side makes invertible Bloom lookup tables of the hashes of its paths: a path goes to one cell of each of three
parts, and a cell holds the number, and the exclusive or, of the hashes in it. The tables of the sides, subtracted, hold
the difference alone, and cells of one hash are taken out until none is left. Only tables leave a side, and the rows of
the difference. A strata estimator, tables of samples of 1/2, 1/4, ... of the paths, tells first how large they must be.
Paths are dealt to shares with tables of a fixed size each, emptied by a task each; a share that cannot be emptied is
compared by an exact join of its paths alone. Where the sides differ so much that the tables would be larger than the
hashed paths themselves, all rows are compared by path at once.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fixity_spark.operators.locations import small
from fixity_spark.schema import KEY

#: Parts of a table, cells of a part, and differences that a share shall have at most. A table can be emptied up to about
#: 0.8 differences a cell, so this leaves room for shares with more than others.
PARTS, CELLS, PER_SHARE = 3, 256, 250
#: Strata of the estimator and cells of a part of each.
STRATA, STRATUM_CELLS = 40, 40
#: A cell is as large as about so many hashed paths: where the tables of both sides would be larger than those, none are made.
CELL_KEYS = 3
#: Rows of a difference that are broadcast to the listings.
SMALL_DIFFERENCE = 1_000_000

#: Fixed values of the hash that Spark's xxhash64 applies to a long.
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
_SEED, _MASK = 42, (1 << 64) - 1


def _turn(x: int, by: int) -> int:
    return (x << by | x >> (64 - by)) & _MASK


def _hash_long(x: int, seed: int) -> int:
    h = (seed + _P5 + 8) & _MASK ^ _turn(x * _P2 & _MASK, 31) * _P1 & _MASK
    h = (_turn(h, 27) * _P1 + _P4) & _MASK
    h = (h ^ h >> 33) * _P2 & _MASK
    h = (h ^ h >> 29) * _P3 & _MASK
    return h ^ h >> 32


def check_of(a: int, b: int) -> int:
    """xxhash64(a, b), as a Spark long."""
    h = _hash_long(b & _MASK, _hash_long(a & _MASK, _SEED))
    return h - (1 << 64) if h >> 63 else h


def places_of(b: int, cells: int) -> list[int]:
    return [((b & _MASK) >> 20 * p & 0xFFFFF) % cells + p * cells for p in range(PARTS)]


def keyed(df: DataFrame, key: list[str]) -> DataFrame:
    """df with two hashes that stand for the path of a row: a and b."""
    told = [x for k in key for x in (F.col(k).isNull(), F.col(k))]
    return df.withColumns({"a": F.xxhash64(F.lit("a"), *told), "b": F.xxhash64(F.lit("b"), *told)})


def tables(keys: DataFrame, share: Column, cells: int) -> DataFrame:
    """Cells of the table of each share: share, cell, n, a, b, c. Summed up in each task before they are shuffled."""
    places = F.array(*[(F.shiftrightunsigned("b", 20 * p).bitwiseAND(0xFFFFF) % cells).cast("int") + p * cells for p in range(PARTS)])
    rows = keys.select(share.cast("long").alias("share"), F.explode(places).alias("cell"), "a", "b", F.xxhash64("a", "b").alias("c"))
    return rows.groupBy("share", "cell").agg(F.count("*").alias("n"), *[F.bit_xor(x).alias(x) for x in "abc"])


def subtracted(one: DataFrame, other: DataFrame) -> DataFrame:
    """The tables of one side minus those of the other: what both hold is gone."""
    both = one.unionByName(other.withColumn("n", -F.col("n")))
    return both.groupBy("share", "cell").agg(F.sum("n").alias("n"), *[F.bit_xor(x).alias(x) for x in "abc"]).where("n <> 0 OR a <> 0 OR b <> 0 OR c <> 0")


def emptied(rows: list[tuple[int, int, int, int, int]], cells: int) -> tuple[list[tuple[int, int, int]], bool]:
    """(side, a, b) of what a table of (cell, n, a, b, c) holds, side 1 or -1, and whether that is all of it."""
    held = {cell: [n, a, b, c] for cell, n, a, b, c in rows}
    found, work = [], list(held)
    while work:
        n, a, b, c = held.get(work.pop(), (0, 0, 0, 0))
        if n not in (1, -1) or check_of(a, b) != c:
            continue
        found.append((n, a, b))
        for p in places_of(b, cells):
            x = held.setdefault(p, [0, 0, 0, 0])
            x[:] = [x[0] - n, x[1] ^ a, x[2] ^ b, x[3] ^ c]
            if any(x):
                work.append(p)
            else:
                del held[p]
    return found, not held


def estimated_difference(one: DataFrame, other: DataFrame) -> int:
    """About how many paths are on one side only, from keys (a, b) of both: exact where there are few."""
    return _estimated(one, other)[0]


def _estimated(one: DataFrame, other: DataFrame) -> tuple[int, int]:
    """The estimated difference, and how many paths both sides have together."""
    stratum = F.least(F.bit_count(F.col("a").bitwiseAND(-F.col("a")) - 1), F.lit(STRATA - 1))
    first, second = (tables(k, stratum, STRATUM_CELLS) for k in (one, other))
    both = first.withColumn("m", F.col("n")).unionByName(second.select("share", "cell", -F.col("n"), "a", "b", "c", F.col("n").alias("m")).toDF(*first.columns, "m"))
    cells = both.groupBy("share", "cell").agg(F.sum("n").alias("n"), *[F.bit_xor(x).alias(x) for x in "abc"], F.sum("m").alias("m")).collect()  # STRATA tables at most
    rows, total = sum(r.m for r in cells) // PARTS, 0
    for k in reversed(range(STRATA)):
        found, whole = emptied([(r.cell, r.n, r.a, r.b, r.c) for r in cells if r.share == k and any((r.n, r.a, r.b, r.c))], STRATUM_CELLS)
        if not whole:
            # the strata above hold a sample of 2 ** -(k + 1); this one holds at least what fills its table
            return max(total << (k + 1), STRATUM_CELLS << (k + 1)), rows
        total += len(found)
    return total, rows


def _decoded(cells: int):
    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table.column(c).to_pylist() for c in ("cell", "n", "a", "b", "c")), strict=True))
        found, whole = emptied(rows, cells)
        share = table.column("share")[0].as_py()
        found = found if whole else [(0, 0, 0)]  # side 0: this share could not be emptied
        return pa.table({"share": pa.array([share] * len(found), pa.int64()), **{c: pa.array([f[k] for f in found], pa.int32() if c == "side" else pa.int64()) for k, c in enumerate(("side", "a", "b"))}})

    return run


def _compared(one: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """What reconcile gives, found by bringing all rows of a path together."""
    both = one.select(F.lit(True).alias("_first"), *one.columns).unionByName(other.select(F.lit(False).alias("_first"), *one.columns))
    by = W.partitionBy(*key)
    told = both.withColumns({"_some": F.max("_first").over(by), "_all": F.min("_first").over(by)}).where("_some = _all")
    return told.select(F.when(F.col("_first"), "missing").otherwise("extra").alias("side"), *one.columns)


def reconcile(one: DataFrame, other: DataFrame, work: str, key: list[str] = KEY, shares: int | None = None, unique: bool = False) -> DataFrame:
    """Rows of one whose key other lacks (side `missing`, J1), and of other whose key one lacks (`extra`, J2).

    Both have the same columns. work is a new folder for the decoded difference. shares, a number of tables, is chosen
    from the estimated difference where it is not given; too few of them only mean exact joins. A path that a side lists
    several times counts once and comes with all its rows; with unique, no path does, which saves a shuffle on each side.
    Where tables would not be smaller than the listings, and shares is not given, rows are compared directly.
    """
    spark = one.sparkSession
    sides = [keyed(df, key) for df in (one, other)]
    keys = [df.select("a", "b") if unique else df.select("a", "b").distinct() for df in sides]
    if shares is None:
        difference, rows = _estimated(*keys)
        wanted, shares = 1.3 * difference / PER_SHARE, 1
        while shares < wanted:
            shares *= 2
        if 2 * shares * PARTS * CELLS * CELL_KEYS >= rows > 0:
            return _compared(one, other, key)
    share = F.pmod(F.col("a"), F.lit(shares))
    cells = subtracted(*(tables(k, share, CELLS) for k in keys))
    cells.groupBy("share").applyInArrow(_decoded(CELLS), "share long, side int, a long, b long").write.mode("overwrite").parquet(f"{work}/difference")
    found = spark.read.schema("share long, side int, a long, b long").parquet(f"{work}/difference")
    shut = small(found.where("side = 0").select(F.col("share").alias("_share")), SMALL_DIFFERENCE)
    left = [df.join(shut, share == F.col("_share"), "left_semi") for df in sides]
    out = None
    for k, (name, side) in enumerate((("missing", 1), ("extra", -1))):
        told = sides[k].join(small(found.where(F.col("side") == side).select("a", "b"), SMALL_DIFFERENCE), ["a", "b"], "left_semi")
        exact = left[k].join(left[1 - k].select(*key), key, "left_anti")
        part = told.unionByName(exact).select(F.lit(name).alias("side"), *one.columns)
        out = part if out is None else out.unionByName(part)
    return out
