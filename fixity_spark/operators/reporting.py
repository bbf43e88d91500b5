"""Scans, totals, matrices and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixity_spark.functions.paths import is_junk, is_numbered, number
from fixity_spark.functions.values import cell_state
from fixity_spark.operators.diff import covered_files
from fixity_spark.operators.locations import SMALL, small
from fixity_spark.schema import COLLECTION


def collection_scan(inv: DataFrame, man: DataFrame) -> DataFrame:
    """A1: bytes, files and whether all are checksummed, per collection and location."""
    return covered_files(inv, man).groupBy(*COLLECTION, "location", "ord").agg(F.sum("bytes").alias("bytes"), F.sum("files").alias("files"), F.bool_and("covered").alias("checksummed"))


def collection_size(scan: DataFrame) -> DataFrame:
    """A2: size of each collection at the first location that has it."""
    return scan.groupBy(*COLLECTION).agg(F.min_by("bytes", "ord").alias("bytes"))


def catalogue_totals(sizes: DataFrame) -> DataFrame:
    """A3: collection, year and grand totals; level is 0, 1 and 3."""
    return sizes.rollup("year", "slug").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("collections"), F.grouping_id().cast("int").alias("level"))


def presence_matrix(scan: DataFrame, loc: DataFrame) -> DataFrame:
    """A4: one row per collection, one column per location with its state; the locations are listed up front.

    The result has a column for each location, so a table of more than SMALL of them is refused.
    """
    names = [(r.name, r.mounted) for r in loc.orderBy("ord").limit(SMALL + 1).collect()]
    if len(names) > SMALL:
        raise ValueError(f"more than {SMALL} locations")
    cell = lambda name, mounted: cell_state(F.lit(mounted), F.max(F.when(F.col("location") == name, F.col("files"))), F.bool_or(F.when(F.col("location") == name, F.col("checksummed")))).alias(name)
    return scan.groupBy(*COLLECTION).agg(*[cell(*x) for x in names])


def years(inv: DataFrame) -> DataFrame:
    """A10: years present, newest first."""
    return inv.select("year").distinct().orderBy(F.desc("year"))


def collections(inv: DataFrame, numbered_only: bool = False) -> DataFrame:
    """Collections over all locations."""
    found = inv.select(*COLLECTION).distinct()
    return found.where(is_numbered(F.col("slug"))) if numbered_only else found


def max_number(inv: DataFrame) -> DataFrame:
    """Highest collection number of each year."""
    return inv.select("year", number(F.col("slug")).alias("num")).where("num > 0").groupBy("year").agg(F.max("num").alias("max_num"))


def transfer_totals(plan: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """A5: files and bytes to copy to each destination, and bytes that are there already.

    The latter come from present(dst, size_bytes), or from a column present of plan (transfer.offers).
    """
    held = F.col("present") if "present" in plan.columns else F.lit(False)
    rows = plan.select("dst", "size_bytes", (~held).alias("todo"))
    if present is not None:
        rows = rows.unionByName(present.select("dst", "size_bytes", F.lit(False).alias("todo")))
    todo = F.col("todo")
    return rows.groupBy("dst").agg(F.count_if(todo).alias("n_files"), F.coalesce(F.sum(F.when(todo, F.col("size_bytes"))), F.lit(0)).alias("to_copy"), F.coalesce(F.sum(F.when(~todo, F.col("size_bytes"))), F.lit(0)).alias("present"))


def bytes_per_destination(plan: DataFrame) -> DataFrame:
    """Bytes over destinations, whole bytes."""
    return plan.agg(F.expr("sum(size_bytes) div count(DISTINCT dst)").alias("bytes_per_destination"))


def capacity_check(totals: DataFrame, loc: DataFrame) -> DataFrame:
    """Whether what is to be copied exceeds the room at each destination."""
    room = small(loc.select(F.col("name").alias("dst"), "avail_bytes"))
    return totals.join(room, "dst").select("dst", "to_copy", "avail_bytes", (F.col("to_copy") > F.col("avail_bytes")).alias("too_large"))


def arrivals_by_day(arrivals: DataFrame) -> DataFrame:
    """Files, bytes and cards of each recording day, in order of day."""
    return arrivals.groupBy("day").agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("bytes"), F.array_sort(F.collect_set("card")).alias("cards")).orderBy("day")


#: Kinds of findings of a check.
KINDS = ("missing", "extra", "ghost", "conflict", "size_diff", "collection_missing", "only_copy")


def check_summary(findings: DataFrame, checked: DataFrame | None = None) -> DataFrame:
    """Counts of each kind of finding per collection, in order, and whether it passes.

    checked (year, slug) lists all collections that were looked at, so that those without findings are in it, too.
    """
    kind = F.lit(None).cast("string")
    rows = findings.select(*COLLECTION, "kind")
    rows = rows if checked is None else rows.unionByName(checked.select(*COLLECTION, kind.alias("kind")))
    out = rows.groupBy(*COLLECTION).agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS], (F.count("kind") == 0).alias("passed"))
    return out.orderBy(*COLLECTION)


def junk_summary(listing: DataFrame) -> DataFrame:
    """Junk rows (rel, is_dir, size_bytes) counted."""
    name = F.element_at(F.split("rel", "/"), -1)
    junk = listing.where(is_junk(name, F.col("is_dir")))
    return junk.agg(F.count_if("is_dir").alias("dirs"), F.count_if(~F.col("is_dir")).alias("files"), F.coalesce(F.sum(F.when(~F.col("is_dir"), F.col("size_bytes"))), F.lit(0)).alias("bytes"))


def sample_per_group(df: DataFrame, by: list[str], order: list[str], n: int = 4) -> DataFrame:
    """The first n rows of each group and how many more there are."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*by)
    ranked = df.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("more", F.greatest(F.count("*").over(w) - n, F.lit(0)))
    return ranked.where(F.col("rank") <= n)
