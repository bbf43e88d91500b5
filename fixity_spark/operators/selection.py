"""Which copy to use: reference, fullest, first and agreed copies, and numbers resolved to collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fixity_spark.functions.paths import number
from fixity_spark.operators.diff import drop_self_entry
from fixity_spark.operators.fingerprint import fingerprint
from fixity_spark.operators.locations import covers_year, small
from fixity_spark.schema import COLLECTION, KEY, require


def copies(inv: DataFrame) -> DataFrame:
    """One row per collection and location: n_files and bytes. The windows below run over this small table."""
    require(inv, "the inventory", *COLLECTION, "location", "ord", "role", "size_bytes")
    return inv.groupBy(*COLLECTION, "location", "ord", "role").agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("bytes"))


def _best(scan: DataFrame, *order: Column) -> DataFrame:
    ranked = scan.withColumn("_rank", F.row_number().over(W.partitionBy(*COLLECTION).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def pick_reference(scan: DataFrame, loc: DataFrame | None = None) -> DataFrame:
    """The first hot copy in location order, else the first cold one among the locations of loc that cover the year.

    A collection that only archives out of scope hold has no reference. Without loc every cold copy counts.
    """
    if loc is not None:
        range_ = small(loc.select(F.col("name").alias("location"), F.col("year_from").alias("_from"), F.col("year_to").alias("_to")))
        scan = scan.join(range_, "location").where((F.col("role") == "hot") | covers_year(F.col("year"), F.col("_from"), F.col("_to"))).drop("_from", "_to")
    return _best(scan, F.when(F.col("role") == "hot", 0).otherwise(1), F.col("ord"))


def pick_fullest(scan: DataFrame, role: str) -> DataFrame:
    """The copy of a role with the most files; ties go to location order."""
    return _best(scan.where(F.col("role") == role), F.col("n_files").desc(), F.col("ord"))


def pick_first(scan: DataFrame, role: str) -> DataFrame:
    """The first copy of a role in location order."""
    return _best(scan.where(F.col("role") == role), F.col("ord"))


def hot_differences(inv: DataFrame) -> DataFrame:
    """Collections whose hot copies list different paths or sizes than their first hot copy, with the count.

    Each (path, size) is counted over the hot copies of its collection: one listed by all of them is the
    same everywhere, any other differs. That takes one shuffle where a join with every other copy takes one each.
    """
    hot = drop_self_entry(inv).where("role = 'hot'")
    n = hot.groupBy(*COLLECTION).agg(F.count_distinct("location").alias("n_hot"))
    listed = hot.groupBy(*KEY, "size_bytes").agg(F.count("*").alias("n_listed"))
    return listed.join(n, COLLECTION).where("n_listed < n_hot").groupBy(*COLLECTION).agg(F.count("*").alias("n_diff"))


def disagreeing(inv: DataFrame) -> DataFrame:
    """Collections (year, slug) whose hot copies list different paths or sizes, told by the fingerprints of the copies:
    one row of each copy is shuffled, no file."""
    hot = drop_self_entry(inv).where("role = 'hot'")
    prints = hot.groupBy(*COLLECTION, "location").agg(fingerprint("rel", "size_bytes").alias("print"))
    return prints.groupBy(*COLLECTION).agg(F.count_distinct("print").alias("n")).where("n > 1").select(*COLLECTION)


def pick_agreed(inv: DataFrame) -> DataFrame:
    """The first hot copy of collections whose hot copies agree on paths and sizes; one pass over the files."""
    hot = drop_self_entry(inv).where("role = 'hot'")
    scan = hot.groupBy(*COLLECTION, "location", "ord", "role").agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("bytes"), fingerprint("rel", "size_bytes").alias("print"))
    by = W.partitionBy(*COLLECTION)
    told = scan.withColumns({"_same": F.min("print").over(by) == F.max("print").over(by), "_rank": F.row_number().over(by.orderBy("ord"))})
    return told.where("_same AND _rank = 1").drop("_same", "_rank", "print")


def first_n(backups: DataFrame, n: int) -> DataFrame:
    """The first n qualifying copies of each collection in location order, and whether there were n."""
    by = W.partitionBy(*COLLECTION)
    ranked = backups.withColumn("rank", F.row_number().over(by.orderBy("ord"))).withColumn("n_qualified", F.count("*").over(by))
    return ranked.where(F.col("rank") <= n).withColumn("enough", F.col("n_qualified") >= n)


def numbered(inv: DataFrame, numbers: list[int]) -> DataFrame:
    """The collections (year, slug) that numbers lead to, in every year."""
    wanted = inv.select("year").distinct().withColumn("num", F.explode(F.array(*map(F.lit, numbers))))
    return resolve_number(inv.select("year", "slug", "ord").distinct(), wanted).select("year", "slug")


def resolve_number(coll: DataFrame, wanted: DataFrame, across_years: bool = False) -> DataFrame:
    """The slug of each wanted (year, num), or num alone across years, newest first.

    coll (year, slug, ord). Within a year the first location in order decides, then the slug. Slugs are
    addressed by the value of their number.
    """
    key = ["num"] if across_years else ["year", "num"]
    named = coll.withColumn("num", number(F.col("slug")))
    order = [F.col("year").desc()] if across_years else []
    found = named.join(wanted.select(*key).distinct(), key, "left_semi")
    ranked = found.withColumn("_rank", F.row_number().over(W.partitionBy(*key).orderBy(*order, "ord", "slug")))
    return ranked.where("_rank = 1").select("num", "year", "slug")
