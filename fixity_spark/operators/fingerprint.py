"""Fingerprints of sets of rows: sums of hashes, so that the order of rows and how they are dealt play no part.

Equal sets have equal fingerprints; different sets of n rows have equal ones with a chance of about 2 ** -128. A
fingerprint is one row whatever it stands for, made with partial sums before its one small shuffle, so copies are told
to be alike without their files meeting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SALTS = ("one", "two")
_LANES = [f"_f{k}" for k in range(2 * len(_SALTS))]
_HALF = (1 << 32) - 1


def hashes(*columns: str | Column) -> list[Column]:
    """Two 64-bit hashes of a row's columns, nulls told apart from other values and by their place."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    told = [x for c in cols for x in (c.isNull(), c)]  # hashes skip nulls
    return [F.xxhash64(F.lit(salt), *told) for salt in _SALTS]


def fingerprint(*columns: str | Column, where: Column | None = None) -> Column:
    """Aggregate: struct of the number of rows and four sums of 32 bits of their hashes; of rows with where only.

    Rows that repeat count each time. A long holds the sums of up to 2 ** 31 rows.
    """
    lanes = [x for h in hashes(*columns) for x in (h.bitwiseAND(_HALF), F.shiftrightunsigned(h, 32))]
    if where is not None:
        lanes = [F.when(where, x) for x in lanes]
    n = F.count("*") if where is None else F.count_if(where)
    return F.struct(n.alias("n"), *[F.coalesce(F.sum(x), F.lit(0)).alias(name) for x, name in zip(lanes, _LANES, strict=True)])


def fingerprints(df: DataFrame, by: list[str], of: list[str], name: str = "print") -> DataFrame:
    """One row per group: by, and the fingerprint of its rows' columns of."""
    return df.groupBy(*by).agg(fingerprint(*of).alias(name))
