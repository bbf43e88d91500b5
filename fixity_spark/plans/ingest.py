"""Ingest of arrivals by recording day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixity_spark.functions.dates import sidecar_date
from fixity_spark.functions.paths import clip_stem
from fixity_spark.operators import diff, locations, numbering


def assign_shot_day(arrivals: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Adds day: the date of the sidecar with the file's stem on the same card, else that of the file."""
    dated = sidecars.select("card", clip_stem(F.col("name")).alias("stem"), sidecar_date(F.col("xml")).alias("shot")).where("shot IS NOT NULL").groupBy("card", "stem").agg(F.min("shot").alias("shot"))
    return arrivals.join(dated, ["card", "stem"], "left").withColumn("day", F.coalesce("shot", F.to_date("mtime"))).drop("shot")


def ingest_plan(arrivals: DataFrame, sidecars: DataFrame, inv: DataFrame, counters: DataFrame, assignments: DataFrame, loc: DataFrame, roles: tuple[str, ...] = ("hot",)) -> tuple[DataFrame, DataFrame]:
    """(year, slug, card, rel, dst, size_bytes) to copy, and duplicate warnings.

    assignments (day, name, slug): a day goes to the existing collection slug, or to a new one called name, or
    nowhere. Files go to <card>/<rel> of their collection, at every mounted location of the roles that lacks them.
    """
    dated = assign_shot_day(arrivals, sidecars).withColumn("year", F.year("day"))
    fresh = assignments.where("slug IS NULL AND name IS NOT NULL").select(F.year("day").alias("year"), "day", "name")
    new = numbering.assign_numbers(fresh, counters).select("day", F.col("slug").alias("new_slug"))
    slugged = dated.join(assignments, "day").join(new, "day", "left").withColumn("slug", F.coalesce("slug", "new_slug")).where("slug IS NOT NULL")
    placed = slugged.select("year", "slug", "card", F.concat_ws("/", "card", "rel").alias("rel"), "size_bytes")
    dst = locations.select_locations(loc).where(F.col("role").isin(*roles)).select(F.col("name").alias("dst"))
    wanted = placed.join(locations.small(dst))
    plan = wanted.join(inv.select("year", "slug", "rel", F.col("location").alias("dst")), ["year", "slug", "rel", "dst"], "left_anti")
    return plan, diff.duplicate_arrivals(dated.select("year", "rel"), inv)
