"""Verification of stored content and building of manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fixity_spark.operators import diff, fixity
from fixity_spark.schema import COLLECTION, KEY
from fixity_spark.scratch import written


def verify(man: DataFrame, content: DataFrame, inv: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Status of each manifest row against content (location, key, content), and its summary per collection.

    Digests of another algorithm than the one computed here (SHA-256) have status other_algo: such a file is neither ok
    nor damaged, is counted in n_other_algo instead of n_failed, and a collection without failures that has some is
    `unverified`. With an inventory, collections that a location holds without a manifest are summed up as no_manifest.
    """
    rows = fixity.verify(man, fixity.digests(content))
    other = F.count_if(F.col("status") == "other_algo")
    summary = rows.groupBy(*COLLECTION).agg(F.count("*").alias("n_files"), F.count_distinct("location").alias("n_locations"), (F.count_if(F.col("status") != "ok") - other).alias("n_failed"), other.alias("n_other_algo"))
    summary = summary.withColumn("state", F.when(F.col("n_failed") > 0, "failed").when(F.col("n_other_algo") > 0, "unverified").otherwise("ok"))
    if inv is not None:
        bare = inv.select(*COLLECTION, "location").distinct().join(man.select(*COLLECTION, "location").distinct(), [*COLLECTION, "location"], "left_anti")
        held = inv.join(bare, [*COLLECTION, "location"], "left_semi").groupBy(*COLLECTION).agg(F.count("*").alias("n_files"), F.count_distinct("location").alias("n_locations"))
        summary = summary.unionByName(held.withColumns({"n_failed": F.lit(0).cast("long"), "n_other_algo": F.lit(0).cast("long"), "state": F.lit("no_manifest")}))
    return rows, summary


def build_manifests(inv: DataFrame, man: DataFrame, computed: DataFrame) -> DataFrame:
    """D3: digests for the locations of a collection that are not fully covered, with a state per path.

    computed (key, location, digest) are digests of stored content. A path is `new` where every uncovered
    location of the collection has it and all digests agree; `conflict`, `unreadable` or `absent` otherwise,
    and one such path keeps the whole collection from being recorded (publish is false). `disputed` tells where a
    covered copy records another digest of the same algorithm for the path, which does not keep it from being recorded.
    """
    rows = diff.by_location(inv, man, computed)
    bare = F.coalesce(F.col("digest") == "", F.lit(True))
    # locations of each collection that hold a file without a digest are open
    open_ = _open(inv, man)
    # a row per copy of a collection, written, so that it goes to the files and they need not go to it
    open_ = written(open_.withColumns({"open": F.lit(True), "n_open": F.count("*").over(W.partitionBy(*COLLECTION))}), "open")
    told = rows.join(open_, [*COLLECTION, "location"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
    mine, found = F.col("open") & F.col("held"), F.col("open") & F.col("held") & F.col("read_digest").isNotNull()
    each = lambda f, when, c: f(F.when(when, F.col(c)))
    path = W.partitionBy(*diff.PATH)
    if "algo" in man.columns:
        told = told.withColumn("kind", each(F.min, found, "read_algo").over(path))
        other = ~F.col("open") & ~bare & F.coalesce(F.col("algo") == F.col("kind"), F.lit(True))
    else:
        other = ~F.col("open") & F.col("listed")
    sums = told.groupBy(*diff.PATH).agg(F.max("n_open").alias("n_open"), F.count_if(mine).alias("n_mine"), F.count_if(found).alias("n_found"), each(F.min, found, "read_digest").alias("low"), each(F.max, found, "read_digest").alias("high"), each(F.min, other, "digest").alias("other_low"), each(F.max, other, "digest").alias("other_high"))
    state = F.when(F.col("n_mine") < F.col("n_open"), "absent").when(F.col("n_found") < F.col("n_mine"), "unreadable").when(F.col("low") != F.col("high"), "conflict").otherwise("new")
    disputed = F.coalesce((F.col("other_low") != F.col("low")) | (F.col("other_high") != F.col("low")), F.lit(False))
    paths = sums.where("n_mine > 0").select(*KEY, state.alias("state"), F.col("low").alias("digest"), disputed.alias("disputed"))
    publish = F.min(F.col("state") == "new").over(W.partitionBy(*COLLECTION))
    return paths.select(*KEY, "state", F.when(F.col("state") == "new", F.col("digest")).alias("digest"), publish.alias("publish"), "disputed")


def _open(inv: DataFrame, man: DataFrame) -> DataFrame:
    """Copies of collections (COLLECTION, location) that are not fully covered."""
    return diff.coverage(inv, man).where("NOT covered").select(*COLLECTION, "location")


def new_manifest_rows(built: DataFrame, inv: DataFrame, man: DataFrame) -> DataFrame:
    """D3: the rows to add to each uncovered location's manifest, of collections that publish."""
    open_ = written(_open(inv, man), "open")
    return built.where("publish").select(*KEY, "digest").join(open_, COLLECTION).select(*KEY, "location", "digest")
