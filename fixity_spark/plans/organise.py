"""Organising loose files, cleaning junk, renumbering and recovering counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixity_spark.functions.dates import season, shot_date
from fixity_spark.functions.paths import ancestors, base_name, depth, is_numbered, manifest_path_is_junk, top, visible
from fixity_spark.operators import numbering, reporting
from fixity_spark.schema import COLLECTION, MANIFEST
from fixity_spark.scratch import written


def organise_candidates(listing: DataFrame, regroup: bool = False) -> DataFrame:
    """visible files that are no manifest, outside folders that begin with an underscore and, unless
    regrouping, outside numbered ones."""
    out = listing.where(visible(F.col("rel")) & (base_name(F.col("rel")) != MANIFEST))
    inside = F.instr("rel", "/") > 0
    out = out.where(~(inside & top(F.col("rel")).startswith("_")))
    return out if regroup else out.where(~(inside & is_numbered(top(F.col("rel")))))


def dated(files: DataFrame, allow_mtime: bool = True) -> DataFrame:
    """Adds shot_at, date_source and season; a column probe (timestamp) is used where there is one."""
    probe = F.col("probe") if "probe" in files.columns else F.lit(None).cast("timestamp")
    day, source = shot_date(probe, F.col("rel"), F.col("mtime"), allow_mtime)
    return files.withColumn("shot_at", day).withColumn("date_source", source).withColumn("season", season(F.col("shot_at")))


def organise_plan(files: DataFrame, counters: DataFrame, inv: DataFrame, regroup: bool = False, allow_mtime: bool = True) -> DataFrame:
    """(location, year, rel, new_slug, new_name) of loose files; those without a date go to _unsorted.

    Names are unique within a collection, and within _unsorted of a location and year.
    """
    found = dated(organise_candidates(files, regroup), allow_mtime)
    slugs = numbering.season_slugs(found, counters, inv).withColumnRenamed("slug", "new_slug")
    placed = found.join(slugs, ["year", "season"], "left").withColumn("new_slug", F.coalesce("new_slug", F.lit("_unsorted")))
    named = numbering.resolve_collisions(placed, ["location", "year", "new_slug"], F.col("season").isNull())
    return named.select("location", "year", "rel", "size_bytes", "new_slug", "new_name")


def season_totals(plan: DataFrame) -> DataFrame:
    """Files and bytes of each group of a plan, in order."""
    return plan.groupBy("location", "year", "new_slug").agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("bytes")).orderBy("location", "year", "new_slug")


def junk_rows(listing: DataFrame) -> DataFrame:
    """Files to drop: junk by name, or inside a junk folder."""
    return listing.where(manifest_path_is_junk(F.col("rel")))


def prune_manifest(man: DataFrame) -> DataFrame:
    """Manifest rows to remove."""
    return man.where(manifest_path_is_junk(F.col("rel")))


def empty_folders(listing: DataFrame, dirs: DataFrame, min_depth: int = 2) -> DataFrame:
    """Folders in dirs(location, dir) at least min_depth below the root that hold no file once junk is gone.

    A folder is empty when it is no ancestor of a file that remains, so nested empties go together; hidden
    files remain, so listing is the unfiltered one.
    """
    kept = listing.where(~manifest_path_is_junk(F.col("rel")))
    used = kept.where("instr(rel, '/') > 0").select("location", F.explode(ancestors(F.col("rel"))).alias("dir")).distinct()
    deep = dirs.where(depth(F.col("dir")) >= min_depth)
    return deep.join(used, ["location", "dir"], "left_anti")


def clean_plan(listing: DataFrame, man: DataFrame, dirs: DataFrame, min_depth: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Junk files, manifest rows to prune and empty folders."""
    return junk_rows(listing), prune_manifest(man), empty_folders(listing, dirs, min_depth)


def renumber_plan(coll: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(year, slug, new_slug) and the counter each year gets."""
    counters = coll.select("year", "slug").distinct().where(is_numbered(F.col("slug"))).groupBy("year").agg(F.count("*").cast("int").alias("last_num"))
    return numbering.renumber_plan(coll), counters


def map_shapes(path_map: DataFrame, work: str) -> DataFrame:
    """What kind of move each slug of a map (year, slug, new_slug) makes: (year, slug, new_slug, shape, last, steps).

    A map is a graph in which every slug has at most one way out. `cycle`: following it comes back to the slug; `merge`: more
    than one slug leads to new_slug; else `chain`. last is where following the map ends, steps the number of moves until
    there (null on and into cycles). Found by pointer doubling: each round every slug learns where twice as many moves
    lead, so rounds, each written below work, grow with the logarithm of the longest chain.
    """
    spark = path_map.sparkSession
    edges = path_map.select("year", "slug", "new_slug").where("slug <> new_slug")
    keep = lambda df, name: (df.write.mode("overwrite").parquet(f"{work}/{name}"), spark.read.parquet(f"{work}/{name}"))[1]
    # reach: where the moves made so far lead, least: the smallest slug on the way
    now = keep(edges.select("year", "slug", F.col("new_slug").alias("reach"), F.lit(1).cast("long").alias("steps"), F.least("slug", "new_slug").alias("least")), "round0")
    n = now.count()
    k = 0
    while (1 << k) <= 2 * n:
        onward = now.select("year", F.col("slug").alias("reach"), F.col("reach").alias("_r"), F.col("steps").alias("_s"), F.col("least").alias("_l"))
        if not now.join(onward, ["year", "reach"], "left_semi").limit(1).count():
            break
        step = now.join(onward, ["year", "reach"], "left").select("year", "slug", F.coalesce("_r", "reach").alias("reach"), (F.col("steps") + F.coalesce("_s", F.lit(0))).alias("steps"), F.least("least", F.coalesce("_l", "least")).alias("least"))
        k += 1
        now = keep(step, f"round{k}")
    # after more moves than there are slugs, one that still has a way out is in, or leads into, a cycle
    ends = now.join(edges.select("year", F.col("slug").alias("reach"), F.lit(True).alias("_loops")), ["year", "reach"], "left")
    on_cycle = ends.where("_loops").select("year", F.col("reach").alias("slug")).distinct()
    closed = on_cycle
    for j in range(k + 1):  # all slugs of a cycle, from those that doubling ended on
        ahead = spark.read.parquet(f"{work}/round{j}").join(closed, ["year", "slug"], "left_semi").select("year", F.col("reach").alias("slug"))
        closed = keep(closed.unionByName(ahead).distinct(), f"cycle{j}")
    shared = edges.groupBy("year", "new_slug").agg(F.count("*").alias("_in"))
    told = ends.join(edges, ["year", "slug"]).join(shared, ["year", "new_slug"]).join(closed.withColumn("_on", F.lit(True)), ["year", "slug"], "left")
    shape = F.when(F.col("_in") > 1, "merge").when(F.col("_on"), "cycle").otherwise("chain")
    free = F.col("_loops").isNull()
    return told.select("year", "slug", "new_slug", shape.alias("shape"), F.when(free, F.col("reach")).alias("last"), F.when(free, F.col("steps")).alias("steps"))


def map_collisions(inv: DataFrame, path_map: DataFrame) -> DataFrame:
    """(year, slug, location, rel, n) of the keys that more than one file would get under the map."""
    return _renamed(inv, path_map).groupBy(*COLLECTION, "location", "rel").agg(F.count("*").alias("n")).where("n > 1")


def _renamed(inv: DataFrame, path_map: DataFrame) -> DataFrame:
    moves = path_map.select(*COLLECTION, "new_slug")
    return inv.join(moves, COLLECTION, "left").withColumns({"_old": F.col("slug"), "slug": F.coalesce("new_slug", "slug")}).drop("new_slug")


def apply_path_map(inv: DataFrame, man: DataFrame, path_map: DataFrame, clash: str = "refuse") -> tuple[DataFrame, DataFrame]:
    """Inventory and manifests under new slugs (year, slug, new_slug), in one join, so slugs may be swapped.

    Manifests of collections that take in or lose files are stale and go. Where files of several collections would get
    one key, clash `refuse` makes reading the result fail (map_collisions lists them), `number` gives all but the one
    from the first slug the next free number before the extension, and `keep` leaves several rows of one key.
    """
    if clash not in ("refuse", "number", "keep"):
        raise ValueError("clash is refuse, number or keep")
    path_map = written(path_map.select(*COLLECTION, "new_slug"), "map")  # small, so that it goes to the files, not they to it
    renamed = _renamed(inv, path_map)
    if clash == "number":
        renamed = numbering.unique_names(renamed, [*COLLECTION, "location"], "rel", "_old")
    elif clash == "refuse":
        # only collections that several slugs lead to can clash: their files alone are counted
        into = path_map.select("year", F.coalesce("new_slug", "slug").alias("slug")).unionByName(inv.select(*COLLECTION).distinct().join(path_map.select(*COLLECTION), COLLECTION, "left_anti"))
        shared = into.groupBy(*COLLECTION).agg(F.count("*").alias("_ways")).where("_ways > 1")
        twice = renamed.join(shared, COLLECTION, "left_semi").groupBy(*COLLECTION, "location", "rel").agg(F.count("*").alias("n"), F.min("slug").alias("_s")).where("n > 1")
        bad = twice.agg(F.count("*").alias("_bad"))  # one row
        stop = F.raise_error(F.concat(F.col("_bad").cast("string"), F.lit(" keys would belong to several files")))
        renamed = renamed.join(F.broadcast(bad), F.lit(True)).withColumn("slug", F.when(F.col("_bad") > 0, stop.cast("string")).otherwise(F.col("slug"))).drop("_bad")
    return renamed.select(*inv.columns), man.join(_touched(path_map), COLLECTION, "left_anti").select(*man.columns)


def _touched(path_map: DataFrame) -> DataFrame:
    return path_map.select(*COLLECTION).unionByName(path_map.select("year", F.col("new_slug").alias("slug"))).distinct()


def stale_manifests(man: DataFrame, path_map: DataFrame) -> DataFrame:
    """The manifest rows that apply_path_map takes out."""
    return man.join(written(_touched(path_map), "touched"), COLLECTION, "left_semi").select(*man.columns)


def recover_counters(inv: DataFrame, counters: DataFrame, year: int | None = None) -> DataFrame:
    """Counters after the highest numbers seen; raised only, or set exactly for a named year."""
    observed = reporting.max_number(inv)
    if year is not None:
        observed = observed.where(F.col("year") == year)
    return numbering.reconcile_counters(observed, counters, exact=year is not None)


def unsorted_names(files: DataFrame) -> DataFrame:
    """Adds new_name, the path with underscores for slashes, unique within a location and year."""
    return numbering.unique_names(files.withColumn("new_name", F.replace("rel", F.lit("/"), F.lit("_"))), ["location", "year"], "new_name")
