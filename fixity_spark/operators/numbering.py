"""Collection numbers, counters, seasons and collision-free names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fixity_spark.functions.dates import season_order
from fixity_spark.functions.paths import base_name, flat_name, is_numbered, number, slug, slug_name
from fixity_spark.operators import locations
from fixity_spark.operators.reporting import max_number
from fixity_spark.scratch import shuffle_buckets, written

#: Equal names of a target that one task numbers; more are numbered in ranges.
CROWD = 100_000
#: Rows of a range, where that makes more ranges than shuffles have partitions.
RANGE = 1_000_000


def renumber_plan(coll: DataFrame) -> DataFrame:
    """(year, slug, new_slug) of numbered collections that are not numbered 1, 2, ... by (number, slug)."""
    own = coll.select("year", "slug").distinct().where(is_numbered(F.col("slug"))).withColumn("num", number(F.col("slug")))
    new = F.format_string("%03d_%s", F.row_number().over(W.partitionBy("year").orderBy("num", "slug")), slug_name(F.col("slug")))
    return own.withColumn("new_slug", new).where("slug <> new_slug").select("year", "slug", "new_slug")


def next_numbers(counters: DataFrame, observed: DataFrame) -> DataFrame:
    """First free number of each year: after the counter and after the highest number seen."""
    both = counters.join(observed, "year", "full_outer")
    return both.select("year", (F.greatest(F.coalesce("last_num", F.lit(0)), F.coalesce("max_num", F.lit(0))) + 1).alias("next_num"))


def season_slugs(dated: DataFrame, counters: DataFrame, inv: DataFrame) -> DataFrame:
    """(year, season, slug) of the seasons in dated(year, season), numbered in order from the next number."""
    found = dated.where("season IS NOT NULL").select("year", "season").distinct()
    first = next_numbers(counters, max_number(inv))
    ranked = found.withColumn("k", F.row_number().over(W.partitionBy("year").orderBy(season_order(F.col("season")))))
    num = F.coalesce("next_num", F.lit(1)) + F.col("k") - 1
    return ranked.join(first, "year", "left").select("year", "season", slug(num, F.col("season")).alias("slug"))


def assign_numbers(days: DataFrame, counters: DataFrame) -> DataFrame:
    """Numbers and slugs of the new collections in days(year, day, name): after the counter, in order of day."""
    ranked = days.withColumn("k", F.row_number().over(W.partitionBy("year").orderBy("day")))
    num = F.coalesce("last_num", F.lit(0)) + F.col("k")
    return ranked.join(counters, "year", "left").select("year", "day", num.alias("num"), slug(num, F.col("name")).alias("slug"))


def reconcile_counters(observed: DataFrame, counters: DataFrame, exact: bool = False) -> DataFrame:
    """Counters (year, last_num, new_num) of the years seen; raised only, or set exactly when a year was named."""
    new = F.col("max_num") if exact else F.greatest("max_num", F.coalesce("last_num", F.lit(0)))
    return observed.join(counters, "year", "left").select("year", F.coalesce("last_num", F.lit(0)).alias("last_num"), new.alias("new_num"))


def peek(counters: DataFrame) -> DataFrame:
    """The number the next collection of each year gets."""
    return counters.select("year", (F.col("last_num") + 1).alias("next_num"))


def step(counters: DataFrame, years: list[int], by: int) -> DataFrame:
    """Counters of some years moved, commit by 1 and revert by -1, never below 0."""
    moved = F.when(F.col("year").isin(*years), F.greatest(F.lit(0), F.col("last_num") + by)).otherwise(F.col("last_num"))
    return counters.select("year", moved.cast("int").alias("last_num"))


def collision_count(files: DataFrame, target: list[str]) -> DataFrame:
    """Adds n_same, the files of a target with the same base name."""
    return files.withColumn("base", base_name(F.col("rel"))).withColumn("n_same", F.count("*").over(W.partitionBy(*target, "base")))


def _ranked(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """rows with _k, their number in a group by (_n, nulls first, order), and _most, the greatest _n of the group.

    Groups of more than CROWD rows, counted first, are not sorted in one task: their rows are dealt by ranges of that order,
    and numbered within a range, after the rows of the group in ranges before it.
    """
    by = W.partitionBy(*group)
    few = lambda df: df.withColumns({"_k": F.row_number().over(by.orderBy(F.col("_n").asc_nulls_first(), order)), "_most": F.max("_n").over(by)})
    crowds = written(rows.groupBy(*group).agg(F.count("*").alias("_size"), F.max("_n").alias("_most")).where(F.col("_size") > CROWD), "crowds")
    if crowds.isEmpty():
        return few(rows)
    named = locations.small(crowds.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_most").alias("_top")))
    alike = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group])
    heavy = rows.join(named, alike, "left_semi").withColumn("_tie", F.xxhash64(*rows.columns))
    sort = [*group, F.col("_n").asc_nulls_first(), F.col(order).asc_nulls_first(), "_tie"]
    count = max(shuffle_buckets(rows.sparkSession), crowds.agg(F.sum("_size")).first()[0] // RANGE)
    ranges = heavy.repartitionByRange(count, *sort).sortWithinPartitions(*sort).drop("_tie")
    # written once, as the numbers of ranges and places must be the same wherever they are used
    placed = written(ranges.withColumn("_place", F.monotonically_increasing_id()), "ranges").withColumn("_range", F.shiftright("_place", 33))
    held = placed.groupBy(*group, "_range").agg(F.min("_place").alias("_start"), F.count("*").alias("_held"))
    before = F.coalesce(F.sum("_held").over(by.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = held.withColumn("_first", F.col("_start") - before).join(named, alike).select(*[f"_g_{c}" for c in group], F.col("_range").alias("_of"), "_first", "_top")
    met = placed.join(locations.small(starts), alike & (F.col("_range") == F.col("_of")))
    numbered = met.select(*rows.columns, (F.col("_place") - F.col("_first") + 1).alias("_k"), F.col("_top").alias("_most"))
    return few(rows.join(named, alike, "left_anti")).unionByName(numbered)


def unique_names(files: DataFrame, target: list[str], name: str = "name", order: str = "rel") -> DataFrame:
    """Column name made unique within a target: of equal names the first in order keeps it, the others get _2, _3, ...
    before the extension, counted on from the highest number that another file of the target bears after that stem.

    So no number is given twice, whatever names the files bring along. Each file goes to its own stem and, where it
    ends in a number, once more to the stem before it: one shuffle tells equal names and numbers taken. Names are counted
    first, and those that very many files bear are numbered by several tasks.
    """
    ext, stem = F.regexp_extract(name, r"(\.[^.]*)$", 1), F.regexp_replace(name, r"\.[^.]*$", "")
    named = files.withColumns({"_ext": ext, "_own": stem})
    # numbers of more than 36 digits count as part of the name
    number = F.nullif(F.regexp_extract("_own", "_([0-9]{1,36})$", 1), F.lit("")).cast("decimal(38,0)")
    itself = F.struct(F.col("_own").alias("_stem"), F.lit(None).cast("decimal(38,0)").alias("_n"))
    bearer = F.struct(F.regexp_replace("_own", "_[0-9]+$", "").alias("_stem"), number.alias("_n"))
    dealt = named.select("*", F.inline(F.when(number.isNull(), F.array(itself)).otherwise(F.array(itself, bearer)))).drop("_own")
    counted = _ranked(dealt, [*target, "_stem", "_ext"], order)
    again = F.concat("_stem", F.lit("_"), (F.greatest(F.coalesce("_most", F.lit(1)), F.lit(1)) + F.col("_k") - 1).cast("decimal(38,0)").cast("string"), "_ext")
    out = counted.where("_n IS NULL").withColumn(name, F.when(F.col("_k") > 1, again).otherwise(F.col(name)))
    return out.drop("_stem", "_ext", "_n", "_k", "_most")


def resolve_collisions(files: DataFrame, target: list[str], plain: Column | None = None) -> DataFrame:
    """Adds new_name, unique within a target: base name, folder-prefixed where shared, then numbered.

    Files for which plain holds bear their whole path, with underscores for slashes, instead.
    """
    name = F.when(F.col("n_same") > 1, flat_name(F.col("rel"))).otherwise(F.col("base"))
    if plain is not None:
        name = F.when(plain, F.replace("rel", F.lit("/"), F.lit("_"))).otherwise(name)
    return unique_names(collision_count(files, target).withColumn("new_name", name), target, "new_name")
