"""Plans to copy files between locations, and their verified execution on content tables."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixity_spark.functions.paths import under_prefix
from fixity_spark.functions.values import content_digest
from fixity_spark.operators import diff, fixity, locations, selection
from fixity_spark.schema import COLLECTION, KEY
from fixity_spark.scratch import drop, folders, move

PLAN = ["year", "slug", "src", "dst", "rel", "size_bytes"]


def _offers(inv: DataFrame, pairs: DataFrame) -> DataFrame:
    """J1 over all (collection, src, dst) pairs at once: files of src, and whether dst has the path (present)."""
    rows = diff.drop_self_entry(inv).select(*KEY, "location", "size_bytes")
    offered = rows.withColumnRenamed("location", "src").join(pairs.select(*COLLECTION, "src", "dst"), [*COLLECTION, "src"]).select(*PLAN)
    there = rows.select(*KEY, F.col("location").alias("dst"), F.lit(True).alias("present")).distinct()
    return offered.join(there, [*KEY, "dst"], "left").select(*PLAN, F.coalesce("present", F.lit(False)).alias("present"))


def _lacking(inv: DataFrame, pairs: DataFrame) -> DataFrame:
    """The files of src whose path dst lacks."""
    rows = diff.drop_self_entry(inv).select(*KEY, "location", "size_bytes")
    offered = rows.withColumnRenamed("location", "src").join(pairs.select(*COLLECTION, "src", "dst"), [*COLLECTION, "src"]).select(*PLAN)
    return offered.join(rows.select(*KEY, F.col("location").alias("dst")), [*KEY, "dst"], "left_anti").select(*PLAN)


def _sources(picked: DataFrame) -> DataFrame:
    return picked.select(*COLLECTION, F.col("location").alias("src"))


def sync_plan(inv: DataFrame, loc: DataFrame, years: list[int] | None = None) -> DataFrame:
    """Files that archives in scope lack, from the hot copies that agree."""
    inv = inv.where(F.col("year").isin(*years)) if years else inv
    return _lacking(inv, locations.expand_destinations(_sources(selection.pick_agreed(inv)), loc, "cold", in_scope=True))


def sync_conflicts(inv: DataFrame) -> DataFrame:
    """Collections left out of the plan because their hot copies differ, with the paths that do."""
    return selection.hot_differences(inv)


def sync_ghosts(inv: DataFrame, man: DataFrame, years: list[int] | None = None) -> DataFrame:
    """Hot copies whose manifests list files that are not there, counted: what is synced from them is
    incomplete, and a run that meets one has failed, whatever it copies."""
    if years:
        inv, man = (df.where(F.col("year").isin(*years)) for df in (inv, man))
    held = inv.where("role = 'hot'").select(*COLLECTION, "location").distinct()
    lost = diff.ghosts(inv.where("role = 'hot'"), man.where("role = 'hot'")).join(held, [*COLLECTION, "location"], "left_semi")
    return lost.groupBy(*COLLECTION, "location").agg(F.count("*").alias("n_ghosts"))


def sync_outcomes(inv: DataFrame, man: DataFrame, loc: DataFrame, years: list[int] | None = None) -> DataFrame:
    """One row per collection with a hot copy: n_diff (paths on which hot copies differ, so nothing is synced), n_ghosts
    (lines of hot manifests without a file), n_files and bytes that the plan copies, and state: `conflict`, `ghosts`, `ok`.

    A run is a success only where every state is ok, so no caller needs to remember the tables behind it.
    """
    if years:
        inv, man = (df.where(F.col("year").isin(*years)) for df in (inv, man))
    hot = inv.where("role = 'hot'").select(*COLLECTION).distinct()
    ghosts = sync_ghosts(inv, man).groupBy(*COLLECTION).agg(F.sum("n_ghosts").alias("n_ghosts"))
    planned = sync_plan(inv, loc).groupBy(*COLLECTION).agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("bytes"))
    out = hot.join(sync_conflicts(inv), COLLECTION, "left").join(ghosts, COLLECTION, "left").join(planned, COLLECTION, "left").na.fill(0, ["n_diff", "n_ghosts", "n_files", "bytes"])
    return out.withColumn("state", F.when(F.col("n_diff") > 0, "conflict").when(F.col("n_ghosts") > 0, "ghosts").otherwise("ok"))


def replicate_plan(inv: DataFrame, loc: DataFrame, years: list[int] | None = None) -> DataFrame:
    """Files that archives in scope lack, from the first cold copy, wherever that is; empty for years with
    one archive in scope or none."""
    inv = inv.where(F.col("year").isin(*years)) if years else inv
    sources = _sources(selection.pick_first(selection.copies(inv), "cold"))
    scoped = locations.scope(inv.select("year").distinct(), loc).groupBy("year").agg(F.count("*").alias("n")).where("n > 1")
    sources = sources.join(scoped, "year", "left_semi")
    return _lacking(inv, locations.expand_destinations(sources, loc, "cold", in_scope=True))


def _pulled(inv: DataFrame, loc: DataFrame, numbers: list[int] | None, sub: str | None, to: list[str] | None, role: str) -> tuple[DataFrame, DataFrame]:
    if numbers:
        inv = inv.join(selection.numbered(inv, numbers), COLLECTION, "left_semi")
    pairs = locations.expand_destinations(_sources(selection.pick_fullest(selection.copies(inv), role)), loc, "hot", to)
    return (inv.where(under_prefix(F.col("rel"), sub)) if sub else inv), pairs


def pull_plan(inv: DataFrame, loc: DataFrame, numbers: list[int] | None = None, sub: str | None = None, to: list[str] | None = None, role: str = "cold") -> DataFrame:
    """Files that hot locations lack, from the fullest cold copy; locations that decline pulls are left out
    unless named. What a request does not find is in unresolved."""
    return _lacking(*_pulled(inv, loc, numbers, sub, to, role))


def pull_offers(inv: DataFrame, loc: DataFrame, numbers: list[int] | None = None, sub: str | None = None, to: list[str] | None = None, role: str = "cold") -> DataFrame:
    """All files of the sources with each destination, and whether it has them already (present)."""
    return _offers(*_pulled(inv, loc, numbers, sub, to, role))


def copy_plan(inv: DataFrame, loc: DataFrame, numbers: list[int] | None = None, sub: str | None = None, to: list[str] | None = None) -> DataFrame:
    """Files that hot locations lack, from the fullest hot copy."""
    return pull_plan(inv, loc, numbers, sub, to, role="hot")


def unresolved(inv: DataFrame, numbers: list[int], sub: str | None = None, role: str = "cold", years: list[int] | None = None) -> DataFrame:
    """(year, num, problem) of requests that lead to nothing: `unknown number`, `no source` of the role,
    or `no such folder` in the source. A run with such a row has failed, though the others are carried out.

    Years are those given, else all that inv has.
    """
    asked = (inv.sparkSession.createDataFrame([(y,) for y in years], "year int") if years else inv.select("year").distinct()).withColumn("num", F.explode(F.array(*map(F.lit, numbers))))
    known = selection.resolve_number(inv.select("year", "slug", "ord").distinct(), asked)
    mine = inv.join(known.select(*COLLECTION), COLLECTION, "left_semi")
    sources = selection.pick_fullest(selection.copies(mine), role).select(*COLLECTION, F.col("location").alias("src"))
    below = F.lit(True) if not sub else under_prefix(F.col("rel"), sub)
    found = mine.where(below).select(*COLLECTION, F.col("location").alias("src")).distinct().withColumn("found", F.lit(True))
    out = asked.join(known, ["year", "num"], "left").join(sources, COLLECTION, "left").join(found, [*COLLECTION, "src"], "left")
    problem = F.when(F.col("slug").isNull(), "unknown number").when(F.col("src").isNull(), "no source").when(F.col("found").isNull(), "no such folder")
    return out.withColumn("problem", problem).where("problem IS NOT NULL").select("year", "num", "problem").orderBy("year", "num")


#: Rows of a plan that are broadcast to the content they ask for.
SMALL_PLAN = 100_000


def execute_plan(plan: DataFrame, content: DataFrame, manifest: DataFrame, target: str) -> DataFrame:
    """D6 (action): copies the planned content into the table at target and returns the merged manifest.

    Content rows are (location, key, content). Copies are staged under target/staged/<run>, read back and
    compared with the source's digest, and that with what the source's manifest records where it names SHA-256 as algorithm;
    only if every planned row is there and verifies does the staged run move to target/copied/run=<run>, and are its rows,
    and no others, merged into the manifest of the destinations. Otherwise nothing but the staged run is left
    (drop_staged) and the call fails. Runs sort by time: `copied` gives the newest copy of each path. The plan is written
    first and the source read once, whatever the number of destinations; a plan of at most SMALL_PLAN rows (counted)
    goes to the content, so that no other content is shuffled.
    """
    spark = plan.sparkSession
    run = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    staged, kept = f"{target}/staged/{run}", f"{target}/copied/run={run}"
    source = content.select(F.col("location").alias("src"), *KEY, "content")
    plan.select("src", "dst", *KEY).write.mode("errorifexists").parquet(f"{staged}/plan")
    wanted = spark.read.parquet(f"{staged}/plan")
    # the plan's content is looked up from the content's side; what is not found is known from the count
    rows = source.join(locations.small(wanted, SMALL_PLAN), ["src", *KEY])
    rows.select("src", F.col("dst").alias("location"), *KEY, "content", content_digest(F.col("content")).alias("sent_digest")).write.mode("errorifexists").parquet(f"{staged}/rows")
    back = spark.read.parquet(f"{staged}/rows")
    digest = content_digest(F.col("content"))
    good = back.where(digest.eqNullSafe(F.col("sent_digest")) & digest.isNotNull()).select("src", *KEY, "location", "sent_digest")
    if "algo" in manifest.columns:
        recorded = manifest.where("algo = 'sha256'").select(F.col("location").alias("src"), *KEY, F.col("digest").alias("_recorded"))
        good = good.join(recorded.join(locations.small(wanted.select("src", *KEY).distinct(), SMALL_PLAN), ["src", *KEY], "left_semi"), ["src", *KEY], "left").where("_recorded IS NULL OR _recorded = sent_digest")
    failed = wanted.select(*KEY, F.col("dst").alias("location")).join(good.select(*KEY, "location"), [*KEY, "location"], "left_anti").count()
    if failed:
        raise RuntimeError(f"{failed} copies are unreadable or differ from their source or its manifest; nothing was recorded")
    move(spark, f"{staged}/rows", kept)
    drop(spark, staged)
    mine = spark.read.parquet(kept).select(*KEY, "location", F.col("sent_digest").alias("digest"), F.lit("sha256").alias("algo"))
    return fixity.merge_manifest(manifest, mine if "algo" in manifest.columns else mine.drop("algo"))


def drop_staged(spark: SparkSession, target: str, older_than_s: float = 24 * 3600.0) -> int:
    """Removes what failed copies left at target/staged: runs that began so many seconds ago or more; their number.

    Runs that move at this moment are younger than that. Copied runs are never touched.
    """
    limit = time.time_ns() - int(older_than_s * 1e9)
    old = [name for name in folders(spark, f"{target}/staged") if name.split("-")[0].isdigit() and int(name.split("-")[0]) <= limit]
    for name in old:
        drop(spark, f"{target}/staged/{name}")
    return len(old)


def copied(spark: SparkSession, target: str) -> DataFrame:
    """The newest copy of each path that execute_plan put at target: location, key, content, digest."""
    rows = spark.read.parquet(f"{target}/copied")
    newest = rows.groupBy(*KEY, "location").agg(F.max("run").alias("run"))
    return rows.join(newest, [*KEY, "location", "run"]).select("location", *KEY, "content", F.col("sent_digest").alias("digest"))
