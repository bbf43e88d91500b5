"""When hot copies may be released: qualifying cold copies and the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fixity_spark.functions.paths import normalise_name
from fixity_spark.operators import diff, selection
from fixity_spark.operators.fingerprint import fingerprint
from fixity_spark.schema import COLLECTION, require

GROUP = [*COLLECTION, "location"]


def _named(df: DataFrame, hot: list[str] | None) -> DataFrame:
    """Without the hot copies that are not named, where some are."""
    return df.where((F.col("role") != "hot") | normalise_name(F.col("location")).isin(*(n.strip().lower() for n in hot))) if hot else df


def _per_location(inv: DataFrame, man: DataFrame) -> DataFrame:
    """What each location has of each collection, with what its hot copies ask for; from one shuffle by path.

    Columns: collection, location, role, ord (null where it holds no file), files, bytes, n_recorded, n_covered
    (hot paths both held and recorded), n_conflicts, n_hot_paths (of the collection).
    """
    rows = diff.by_location(inv, man)
    path, same = W.partitionBy(*diff.PATH), W.partitionBy(*diff.PATH, "algo")
    hot, cold = F.col("role") == "hot", F.col("role") == "cold"
    digest = lambda by, also=F.lit(True): (F.min(F.when(hot & also, F.col("digest"))).over(by), F.max(F.when(hot & also, F.col("digest"))).over(by))
    # hot lines that a line is compared with: of its algorithm, of none named, or, if it names none, all
    unlike = lambda pair: F.coalesce((pair[0] != F.col("digest")) | (pair[1] != F.col("digest")), F.lit(False))
    differs = unlike(digest(path)) if "algo" not in man.columns else unlike(digest(same)) | unlike(digest(path, F.col("algo").isNull())) | (F.col("algo").isNull() & unlike(digest(path)))
    told = rows.withColumns({"hot_path": F.max(hot & F.col("held")).over(path), "_first": F.row_number().over(path.orderBy("location")) == 1, "_differs": differs})
    told = told.withColumns({"covered": F.col("hot_path") & F.col("held") & F.coalesce(F.col("digest") != "", F.lit(False)), "differs": cold & F.col("listed") & F.col("_differs")})
    count = lambda c, name: F.count_if(c).alias(name)
    per = told.groupBy(*GROUP, "role").agg(F.min("ord").alias("ord"), count("held", "files"), F.sum("size_bytes").alias("bytes"), count("listed", "n_recorded"), count("covered", "n_covered"), count("differs", "n_conflicts"), count(F.col("_first") & F.col("hot_path"), "_paths"))
    # few rows are left: one for each copy of a collection
    return per.withColumn("n_hot_paths", F.sum("_paths").over(W.partitionBy(*COLLECTION))).drop("_paths")


def _judged(per: DataFrame) -> DataFrame:
    """The copies of collections that have a hot one, judged as backups; hot copies do not qualify."""
    held = per.where("files > 0 AND n_hot_paths > 0").withColumns({"n_uncovered": F.col("n_hot_paths") - F.col("n_covered"), "has_manifest": F.col("n_recorded") > 0})
    return held.withColumn("qualifies", (F.col("role") == "cold") & F.col("has_manifest") & (F.col("n_uncovered") == 0) & (F.col("n_conflicts") == 0))


def _reason() -> Column:
    """Why a cold copy that does not qualify is refused."""
    files, digests = (F.col(c).cast("string") for c in ("n_uncovered", "n_conflicts"))
    return F.when(~F.col("has_manifest"), "no manifest").when(F.col("n_uncovered") > 0, F.concat(F.lit("missing "), files, F.lit(" files"))).when(F.col("n_conflicts") > 0, F.concat(digests, F.lit(" different digests")))


def backups(inv: DataFrame, man: DataFrame, hot: list[str] | None = None) -> DataFrame:
    """Every cold copy of a collection that has a hot copy, with what speaks against it.

    Columns: collection, location, ord, n_uncovered, n_conflicts, has_manifest, n_recorded, qualifies. A location's
    year range plays no part here. hot names the hot locations whose copies are to go; others are left out of account.
    """
    judged = _judged(_per_location(_named(inv, hot), _named(man, hot))).where("role = 'cold'")
    return judged.select(*GROUP, "ord", "n_uncovered", "n_conflicts", "has_manifest", "n_recorded", "qualifies")


def reasons(judged: DataFrame) -> DataFrame:
    """Why each cold copy that does not qualify was refused."""
    return judged.where("NOT qualifies").select(*COLLECTION, "location", "ord", _reason().alias("reason"))


def verdict(inv: DataFrame, man: DataFrame, min_copies: int = 1, hot: list[str] | None = None) -> DataFrame:
    """Per collection with a hot copy: bytes its release frees, qualifying copies, whether they suffice
    and the reasons against the others."""
    judged = _judged(_per_location(_named(inv, hot), _named(man, hot)))
    is_hot = F.col("role") == "hot"
    refused = F.collect_list(F.when(~is_hot & ~F.col("qualifies"), F.struct("ord", "location", _reason().alias("reason"))))
    out = judged.groupBy(*COLLECTION).agg(F.sum(F.when(is_hot, F.col("bytes"))).alias("freed_bytes"), F.count_if(is_hot).alias("n_hot"), F.count_if("qualifies").alias("n_qualifying"), F.count_if(~is_hot).alias("n_cold"), F.array_sort(refused).alias("why"))
    text = F.array_join(F.transform("why", lambda r: F.concat(r["location"], F.lit(": "), r["reason"])), "; ")
    text = F.when(F.col("n_cold") == 0, "no cold copy").otherwise(text)
    return out.select(*COLLECTION, "freed_bytes", "n_hot", "n_qualifying", text.alias("reasons"), (F.col("n_qualifying") >= min_copies).alias("releasable"))


def evict_plan(inv: DataFrame, man: DataFrame, min_copies: int = 1, hot: list[str] | None = None, work: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Hot copies that may go (targets) and the cold copies that justify it (the first min_copies).

    hot names the hot locations to release from; without it all of them. With work, a folder, both are written there, a row
    per copy, so that the gate, which needs them several times, does not judge all files again each time.
    """
    inv, man = _named(inv, hot), _named(man, hot)
    chosen = _kept(selection.first_n(backups(inv, man).where("qualifies"), min_copies).where("enough"), work, "chosen")
    targets = selection.copies(diff.drop_self_entry(inv)).where("role = 'hot'")
    return _kept(targets.join(chosen.select(*COLLECTION).distinct(), COLLECTION, "left_semi"), work, "targets"), chosen


def _kept(df: DataFrame, work: str | None, name: str) -> DataFrame:
    """df as a table in the folder work, where there is one."""
    if work is None:
        return df
    df.write.mode("overwrite").parquet(f"{work}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{work}/{name}")


def of_chosen(df: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of the chosen backups: the gate asks for the verification of no others."""
    return df.join(chosen.select(*GROUP), GROUP, "left_semi")


def _unproved(chosen: DataFrame, man: DataFrame, verified: DataFrame, work: str | None) -> DataFrame:
    """Lines of each chosen backup's manifest that are not proved, counted (GROUP, n_failed).

    First whole backups are compared by fingerprints: where the verified lines, all ok, are the very lines of the
    manifest, nothing failed. Only the lines of other backups meet one by one, as verified may lack lines, hold lines of
    other files or hold some twice. A line is proved where every row of verified that speaks of it, and one at least, is
    ok. verified may name the digest that was verified (digest); another one is no proof of the line.
    """
    line = [*GROUP, "rel", *(["digest"] if "digest" in verified.columns else [])]
    lines = of_chosen(diff.drop_self_entry(man), chosen).select(*line)
    seen = of_chosen(verified, chosen).select(*line, (F.col("status") == "ok").alias("ok"))
    said = F.coalesce("ok", F.lit(False))
    both = lines.withColumns({"listed": F.lit(True), "ok": F.lit(True)}).unionByName(seen.withColumns({"listed": F.lit(False), "ok": said}))
    prints = both.groupBy(*GROUP).agg(fingerprint(*line[3:], where=F.col("listed")).alias("a"), fingerprint(*line[3:], where=~F.col("listed")).alias("b"), F.bool_and("ok").alias("all_ok"))
    alike = _kept(prints.where("all_ok AND a = b").select(*GROUP), work, "alike")
    open_ = _kept(chosen.select(*GROUP).join(alike, GROUP, "left_anti"), work, "open")
    proof = seen.join(open_, GROUP, "left_semi").groupBy(*line).agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("proved"))
    judged = lines.join(open_, GROUP, "left_semi").distinct().join(proof, line, "left")
    failed = judged.groupBy(*GROUP).agg(F.count_if(~F.coalesce("proved", F.lit(False))).alias("n_failed"))
    # a backup without a line proves nothing
    rest = open_.join(failed, GROUP, "left").select(*GROUP, F.coalesce("n_failed", F.lit(1).cast("long")).alias("n_failed"))
    return alike.withColumn("n_failed", F.lit(0).cast("long")).unionByName(rest)


def evict_gate(targets: DataFrame, chosen: DataFrame, man: DataFrame | None = None, verified: DataFrame | None = None, strict: bool = True, quick: bool = False, work: str | None = None) -> DataFrame:
    """Targets that pass: every line of the manifests of their backups verifies; with strict, one failure stops all.

    man: manifest rows; verified: manifest rows with their status (J10). A line of a chosen backup that is not in
    verified counts as failed, whatever other lines are there, so nothing passes for want of a verification; neither does
    a target without a chosen backup. With quick the recorded digests are trusted unread, and both may be left out. With work, a folder,
    the backups that fingerprints prove and the judged targets, a row per copy, are written there, so that all lines are
    read for the fingerprints once and the others once more.
    """
    if quick:
        out = targets.join(chosen.groupBy(*COLLECTION).agg(F.lit(0).cast("long").alias("n_failed")), COLLECTION, "left")
    elif verified is None or man is None:
        raise ValueError("without quick, the manifest and its verification are needed")
    else:
        require(man, "the manifest", *GROUP, "rel", "digest")
        require(verified, "the verification", *GROUP, "rel", "status")
        out = targets.join(_unproved(chosen, man, verified, work).groupBy(*COLLECTION).agg(F.sum("n_failed").alias("n_failed")), COLLECTION, "left")
    out = _kept(out, work, "judged")
    passed = F.coalesce(F.col("n_failed") == 0, F.lit(False))
    if not strict:
        return out.withColumn("passed", passed)
    total = out.agg(F.coalesce(F.bool_and(passed), F.lit(True)).alias("_all"))  # one row
    return out.join(F.broadcast(total), F.lit(True)).withColumn("passed", F.col("_all")).drop("_all")

