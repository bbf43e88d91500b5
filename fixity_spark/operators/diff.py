"""Differences between replicas: missing, extra, ghost, conflicting and uncovered files.

inv rows are (year, slug, location, ord, role, rel, size_bytes), man rows (year, slug, location, ord, role, rel, digest)
and may name the algorithm of a digest (algo). Digests of different named algorithms are never compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fixity_spark.functions.paths import base_name
from fixity_spark.schema import COLLECTION, KEY, MANIFEST, require


#: The key of a file with a hash of it in front (told), by which sorts decide most comparisons without reading strings.
PATH = ["_path", *KEY]


def told(df: DataFrame) -> DataFrame:
    """df with the hash that PATH begins with."""
    return df.withColumn("_path", F.xxhash64(*KEY))


def drop_self_entry(df: DataFrame) -> DataFrame:
    """without rows in which a manifest lists itself."""
    return df.where(F.col("rel") != MANIFEST)


def at(df: DataFrame, location: str) -> DataFrame:
    return df.where(F.col("location") == location)


def missing(src: DataFrame, dst: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Rows of src whose path dst lacks; sizes are not compared."""
    return src.join(dst.select(*key), key, "left_anti")


def extra(ref: DataFrame, other: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Rows of other whose path ref lacks."""
    return missing(other, ref, key)


def ghosts(inv: DataFrame, man: DataFrame) -> DataFrame:
    """Manifest rows without a file at the same location."""
    return missing(drop_self_entry(man), inv, [*KEY, "location"])


def manifest_conflicts(ref: DataFrame, other: DataFrame) -> DataFrame:
    """Paths that both manifests record with different digests."""
    left = drop_self_entry(ref).select(*KEY, F.col("digest").alias("ref_digest"), algo(ref).alias("_a"))
    right = other.select(*KEY, "location", F.col("digest").alias("other_digest"), algo(other).alias("_b"))
    return left.join(right, KEY).where("ref_digest <> other_digest").where(F.coalesce(F.col("_a") == F.col("_b"), F.lit(True))).drop("_a", "_b")


def algo(df: DataFrame) -> Column:
    """The algorithm of each row's digest; null where it is not named."""
    return F.col("algo") if "algo" in df.columns else F.lit(None).cast("string")


def differs(a: Column, b: Column) -> Column:
    """Whether two entries of recorded hold digests that differ and may be compared; null where one has none."""
    return (a["digest"] != b["digest"]) & F.coalesce(a["algo"] == b["algo"], F.lit(True))


def covered_files(inv: DataFrame, man: DataFrame) -> DataFrame:
    """Files by (key, location, ord) with files and bytes listed, and covered: whether a digest is recorded at that location.

    An empty digest is none, and a key with a null is recorded nowhere. Both sides are grouped as one table and not joined:
    rows that lie dealt by path already are not shuffled again. Lines said twice count once.
    """
    ord_, size = (F.col(c) if c in inv.columns else F.lit(None) for c in ("ord", "size_bytes"))
    whole = F.lit(True)
    for k in (*KEY, "location"):
        whole &= F.col(k).isNotNull()
    listed = drop_self_entry(inv).select(*KEY, "location", ord_.cast("int").alias("ord"), F.lit(1).cast("long").alias("files"), size.cast("long").alias("bytes"), F.lit(False).alias("covered"))
    lines = man.where(whole & (F.col("digest") != "")).select(*KEY, "location", F.lit(None).cast("int").alias("ord"), F.lit(0).cast("long").alias("files"), F.lit(None).cast("long").alias("bytes"), whole.alias("covered"))
    sums = [F.max("ord").alias("ord"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.bool_or("covered").alias("covered")]
    return listed.unionByName(lines).groupBy(*KEY, "location").agg(*sums).where("files > 0")


def side_by_side(inv: DataFrame, man: DataFrame, computed: DataFrame | None = None) -> DataFrame:
    """Every path once, with what each location lists and records: one shuffle by the full file key for all rules.

    Columns: key, held array<(ord, location, role, size_bytes)>, recorded array<(location, role, digest, algo)> and, with
    computed digests, read array<(location, digest, algo)>; each sorted, each as long as there are locations with the path.
    Self entries are left out; an empty digest is kept, as it is a line of its manifest.
    """
    require(inv, "the inventory", *KEY, "location", "ord", "role", "size_bytes")
    require(man, "the manifest", *KEY, "location", "role", "digest")
    none = F.lit(None)
    held, recorded, read = "struct<ord int,location string,role string,size_bytes bigint>", "struct<location string,role string,digest string,algo string>", "struct<location string,digest string,algo string>"
    rows = drop_self_entry(inv).select(*KEY, F.struct(F.col("ord").cast("int").alias("ord"), "location", "role", "size_bytes").cast(held).alias("held"), none.cast(recorded).alias("recorded"), none.cast(read).alias("read"))
    rows = rows.unionByName(drop_self_entry(man).select(*KEY, none.cast(held).alias("held"), F.struct("location", "role", "digest", algo(man).alias("algo")).cast(recorded).alias("recorded"), none.cast(read).alias("read")))
    if computed is not None:
        rows = rows.unionByName(drop_self_entry(computed).select(*KEY, none.cast(held).alias("held"), none.cast(recorded).alias("recorded"), F.struct("location", "digest", algo(computed).alias("algo")).cast(read).alias("read")))
    # collect_list drops nulls, so each array holds its own kind only
    return rows.groupBy(*KEY).agg(*[F.array_sort(F.collect_list(c)).alias(c) for c in ("held", "recorded", "read")])


def by_location(inv: DataFrame, man: DataFrame, computed: DataFrame | None = None) -> DataFrame:
    """What each location has of each path, one row per (key, location), dealt by the path so that windows and groups by it
    need no further shuffle, nor another sort where they name PATH.

    Columns: _path, key, location, role, ord, size_bytes (null where it lists no such file), held, listed, digest, algo and, with
    computed digests, read_digest and read_algo. Self entries are left out.
    """
    require(inv, "the inventory", *KEY, "location", "ord", "role", "size_bytes")
    require(man, "the manifest", *KEY, "location", "role", "digest")
    text = F.lit(None).cast("string")
    none = {"role": text, "ord": F.lit(None).cast("int"), "size_bytes": F.lit(None).cast("long"), "held": F.lit(False), "listed": F.lit(False), "digest": text, "algo": text, "read_digest": text, "read_algo": text}
    # under names of their own, so that a union of rows that lie dealt alike, by whatever part of the path, is known to lie so
    own_key = {k: f"_{k}" for k in KEY}
    row = lambda df, **own: drop_self_entry(df).select(*[F.col(k).alias(n) for k, n in own_key.items()], "location", *[c.alias(k) for k, c in {**none, **own}.items()])
    rows = row(inv, role=F.col("role"), ord=F.col("ord").cast("int"), size_bytes=F.col("size_bytes").cast("long"), held=F.lit(True))
    rows = rows.unionByName(row(man, role=F.col("role"), listed=F.lit(True), digest=F.col("digest"), algo=algo(man)))
    if computed is not None:
        rows = rows.unionByName(row(computed, read_digest=F.col("digest"), read_algo=algo(computed)))
    largest = [c for c in none if computed is not None or not c.startswith("read")]
    # the window asks for the rows of a path in one task, in the order that the groups need: a repartition would deal rows anew
    # that lie so already
    path = ["_path", *own_key.values()]
    together = rows.withColumn("_path", F.xxhash64(*path[1:])).withColumn("_n", F.row_number().over(W.partitionBy(*path).orderBy("location"))).where("_n > 0").drop("_n")
    grouped = together.groupBy(*path, "location").agg(*[F.max(c).alias(c) for c in largest])
    return grouped.select("_path", *[F.col(n).alias(k) for k, n in own_key.items()], "location", *largest)


def of(entries: Column, location: Column) -> Column:
    """The entry of a location in an array of side_by_side; null where it has none."""
    return F.try_element_at(F.filter(entries, lambda e: e["location"] == location), F.lit(1))


def coverage(inv: DataFrame, man: DataFrame) -> DataFrame:
    """Per collection and location, files, files without a digest, and whether all are covered."""
    files = covered_files(inv, man)
    counted = files.groupBy(*COLLECTION, "location").agg(F.sum("files").alias("files"), F.coalesce(F.sum(F.when(~F.col("covered"), F.col("files"))), F.lit(0)).alias("uncovered"))
    return counted.withColumn("covered", F.col("uncovered") == 0)


def listing_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Collections of a and b with the paths that either lacks at that size (n_diff)."""
    one = a.select(*KEY, "size_bytes", F.lit(1).alias("_a"))
    two = b.select(*KEY, "size_bytes", F.lit(1).alias("_b"))
    both = one.join(two, [*KEY, "size_bytes"], "full_outer")
    return both.where("_a IS NULL OR _b IS NULL").groupBy(*COLLECTION).agg(F.count("*").alias("n_diff"))


def duplicate_arrivals(arrivals: DataFrame, inv: DataFrame) -> DataFrame:
    """Base names of arrivals that collections of the year hold already, counted once each per collection."""
    names = arrivals.select("year", base_name(F.col("rel")).alias("base")).distinct()
    held = inv.select(*COLLECTION, base_name(F.col("rel")).alias("base"))
    return held.join(names, ["year", "base"], "left_semi").groupBy(*COLLECTION).agg(F.count_distinct("base").alias("n_names"))


def union_listing(inv: DataFrame) -> DataFrame:
    """Each path once, as the first location in order lists it."""
    return inv.groupBy(*KEY).agg(F.min_by("size_bytes", "ord").alias("size_bytes"), F.min_by("location", "ord").alias("location"))


def shared_paths(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paths in both manifests."""
    return a.select(*KEY).intersect(b.select(*KEY))
