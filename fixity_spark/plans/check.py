"""Replica checks: every collection's reference copy against the archives in scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fixity_spark.operators import diff, locations, reporting, selection
from fixity_spark.operators.fingerprint import fingerprint
from fixity_spark.schema import COLLECTION, KEY
from fixity_spark.scratch import written

#: Rows of a list of collections that is broadcast to files (counted); a longer one is left to the optimizer.
OPEN = 1_000_000
_FINDING = "array<struct<location:string,kind:string,ref_digest:string,other_digest:string>>"


def targets(inv: DataFrame, loc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reference copy of each collection (ref) and, for each, the archives in scope other than itself (dst)."""
    reference = selection.pick_reference(selection.copies(inv), loc).select(*COLLECTION, F.col("location").alias("ref"))
    return reference, locations.scope(reference, loc).where("dst <> ref")


def _facts(inv: DataFrame, loc: DataFrame) -> DataFrame:
    """One row per collection with a reference: ref, ref_role and targets array<(dst, held)> in location order.

    All of it comes from one row per collection and location; nothing here grows with the files.
    """
    copies = selection.copies(inv).withColumn("copies", F.collect_set("location").over(W.partitionBy(*COLLECTION)))
    picked = selection.pick_reference(copies, loc).select(*COLLECTION, F.col("location").alias("ref"), F.col("role").alias("ref_role"), "copies")
    dim = locations.select_locations(loc, "cold").select(F.col("name").alias("dst"), F.col("ord").alias("dst_ord"), F.col("year_from").alias("_from"), F.col("year_to").alias("_to"))
    target = F.when(F.col("dst") != F.col("ref"), F.struct("dst_ord", "dst", F.array_contains("copies", F.col("dst")).alias("held")))
    facts = locations.in_range(picked, dim, "left").groupBy(*COLLECTION, "ref", "ref_role").agg(F.array_sort(F.collect_list(target)).alias("targets"))
    # written, so that they go to the files where they are few, and are made once
    return written(facts, "facts")


def _entry(reference: str, held, dst):
    """What stands for the reference in comparing with dst: its entry, or the first of the reference's role."""
    if reference == "first":
        return diff.of(held, F.col("ref"))
    return F.try_element_at(F.filter(held, lambda e: (e["role"] == F.col("ref_role")) & (e["location"] != dst)), F.lit(1))


def compare(inv: DataFrame, loc: DataFrame, reference: str = "first") -> DataFrame:
    """Paths of the reference copy and of each archive in scope, side by side.

    With reference "union", a path of any copy of the reference's role stands for the reference, at the size of
    the first location that lists it, so that a file only on a second hot copy is seen.

    Columns: collection, rel, dst, ref_size, dst_size; a null size means the file is not there. Archives that
    hold nothing of the collection are left out; see only_copies.
    """
    if reference not in ("first", "union"):
        raise ValueError("reference is first or union")
    nothing = inv.select(*KEY, "location", "role", F.lit(None).cast("string").alias("digest")).limit(0)
    files = diff.side_by_side(inv, nothing).join(_facts(inv, loc), COLLECTION)
    each = F.transform(F.filter("targets", lambda t: t["held"]), lambda t: F.struct(t["dst"].alias("dst"), _entry(reference, F.col("held"), t["dst"])["size_bytes"].alias("ref_size"), diff.of(F.col("held"), t["dst"])["size_bytes"].alias("dst_size")))
    return files.select(*KEY, F.inline(each)).where("ref_size IS NOT NULL OR dst_size IS NOT NULL")


def findings(inv: DataFrame, man: DataFrame, loc: DataFrame, reference: str = "first", among: DataFrame | None = None, facts: DataFrame | None = None) -> DataFrame:
    """Missing, extra, size_diff, ghost and conflict rows per file, and per collection collection_missing
    (an archive in scope holds nothing of it) and only_copy (an archive holds it, and no other is in scope). Digests of
    different algorithms (algo) are no conflict.

    Columns: year, slug, location, kind, rel (null for a whole collection), ref_digest, other_digest. Files and
    manifest lines meet in one shuffle by path; what is to be compared with what is a small table beside it. Of
    collections that are not among (open_collections), no file is looked at. facts are those of _facts, where they are at hand.
    """
    if reference not in ("first", "union"):
        raise ValueError("reference is first or union")
    facts = _facts(inv, loc) if facts is None else facts
    if among is not None:
        inv, man = (df.join(among, COLLECTION, "left_semi") for df in (inv, man))
    of_files = _of_files(inv, man, facts) if reference == "first" else _of_files_by_union(inv, man, facts)
    gone = F.transform(F.filter("targets", lambda t: ~t["held"]), lambda t: F.struct(t["dst"].alias("location"), F.lit("collection_missing").alias("kind")))
    alone = F.when((F.col("ref_role") == "cold") & (F.size("targets") == 0), F.array(F.struct(F.col("ref").alias("location"), F.lit("only_copy").alias("kind"))))
    none = F.lit(None).cast("string")
    of_collections = facts.select(*COLLECTION, F.inline(F.coalesce(alone, gone))).withColumns({"rel": none, "ref_digest": none, "other_digest": none})
    return of_files.unionByName(of_collections).select(*COLLECTION, "location", "kind", "rel", "ref_digest", "other_digest")


def _of_files(inv: DataFrame, man: DataFrame, facts: DataFrame) -> DataFrame:
    """Findings per file against the first reference.

    Every file and line goes to each archive that it is compared at: those of the reference once for each target, those of
    a target to itself, and the reference's own lines to itself, for its ghosts. Which go where is a row per collection and
    pair beside them; then the two sides of each path and archive meet in one group.
    """
    side = lambda location, dst, ref, held: F.struct(location.alias("location"), dst.alias("dst"), F.lit(ref).alias("is_ref"), held.alias("same"))
    ref = F.col("ref")
    sides = F.concat(F.array(side(ref, ref, False, F.lit(False))), F.flatten(F.transform("targets", lambda t: F.array(side(ref, t["dst"], True, t["held"]), side(t["dst"], t["dst"], False, t["held"])))))
    asks = facts.select(*COLLECTION, F.inline(sides))
    text = F.lit(None).cast("string")
    files = diff.drop_self_entry(inv).select(*KEY, "location", F.col("size_bytes").cast("long").alias("size"), F.lit(False).alias("line"), text.alias("digest"), text.alias("algo"))
    lines = diff.drop_self_entry(man).select(*KEY, "location", F.lit(None).cast("long").alias("size"), F.lit(True).alias("line"), "digest", diff.algo(man).alias("algo"))
    sent = diff.told(files.unionByName(lines)).join(asks, [*COLLECTION, "location"])
    is_ref, line = F.col("is_ref"), F.col("line")
    both = sent.groupBy(*diff.PATH, "dst").agg(
        F.max("same").alias("same"), F.max(F.when(is_ref, F.col("size"))).alias("a_size"), F.max(F.when(~is_ref, F.col("size"))).alias("b_size"), F.bool_or(line & ~is_ref).alias("b_line"),
        F.max(F.when(is_ref & line, F.col("digest"))).alias("a"), F.max(F.when(~is_ref & line, F.col("digest"))).alias("b"), F.max(F.when(is_ref, F.col("algo"))).alias("a_algo"), F.max(F.when(~is_ref, F.col("algo"))).alias("b_algo"),
    )
    kinds = {
        "missing": F.col("same") & F.col("a_size").isNotNull() & F.col("b_size").isNull(),
        "extra": F.col("same") & F.col("a_size").isNull() & F.col("b_size").isNotNull(),
        "size_diff": F.col("same") & (F.col("a_size") != F.col("b_size")),
        "ghost": F.col("b_line") & F.col("b_size").isNull(),
        "conflict": (F.col("a") != F.col("b")) & F.coalesce(F.col("a_algo") == F.col("b_algo"), F.lit(True)),
    }
    kinds = {k: F.coalesce(c, F.lit(False)) for k, c in kinds.items()}
    found = both.where(F.greatest(*kinds.values()))
    each = found.withColumn("kind", F.explode(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]))).where("kind IS NOT NULL")
    digest = lambda c, name: F.when(F.col("kind") == "conflict", F.col(c)).alias(name)
    return each.select(*COLLECTION, "rel", F.col("dst").alias("location"), "kind", digest("a", "ref_digest"), digest("b", "other_digest"))


def _of_files_by_union(inv: DataFrame, man: DataFrame, facts: DataFrame) -> DataFrame:
    """Findings per file where any copy of the reference's role stands for it: all locations of a path side by side."""
    none = F.lit(None).cast("string")
    row = lambda when, location, kind, a=none, b=none: F.when(when, F.struct(location.alias("location"), F.lit(kind).alias("kind"), a.alias("ref_digest"), b.alias("other_digest")))
    held, recorded, ref = F.col("held"), F.col("recorded"), F.col("ref")

    def of_target(t):
        one, other = _entry("union", held, t["dst"])["size_bytes"], diff.of(held, t["dst"])["size_bytes"]
        a, b = diff.of(recorded, ref), diff.of(recorded, t["dst"])
        return F.array(
            row(t["held"] & one.isNotNull() & other.isNull(), t["dst"], "missing"),
            row(t["held"] & one.isNull() & other.isNotNull(), t["dst"], "extra"),
            row(t["held"] & (one != other), t["dst"], "size_diff"),
            row(diff.of(recorded, t["dst"]).isNotNull() & other.isNull(), t["dst"], "ghost"),
            row(diff.differs(a, b), t["dst"], "conflict", a["digest"], b["digest"]),
        )

    of_ref = F.array(row(diff.of(recorded, ref).isNotNull() & diff.of(held, ref).isNull(), ref, "ghost"))
    rows = F.filter(F.flatten(F.concat(F.array(of_ref), F.transform("targets", of_target))).cast(_FINDING), lambda r: r.isNotNull())
    return diff.side_by_side(inv, man).join(facts, COLLECTION).select(*COLLECTION, "rel", F.inline(rows))


def open_collections(inv: DataFrame, man: DataFrame, loc: DataFrame) -> DataFrame:
    """Collections (year, slug) in which some file or line may differ; in all others no finding of a file is possible.

    Told by fingerprints of what each copy lists (paths and sizes), records (paths and digests), and of the paths alone of
    both: a copy whose manifest lists its very files has no ghosts, copies that list and record alike neither lack nor
    dispute anything. Before the shuffle of files, that is one row per copy and task.
    """
    files = diff.drop_self_entry(inv).select(*COLLECTION, "location", "rel", "size_bytes", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("algo"), F.lit(True).alias("file"))
    lines = diff.drop_self_entry(man).select(*COLLECTION, "location", "rel", F.lit(None).cast("long").alias("size_bytes"), "digest", diff.algo(man).alias("algo"), F.lit(False).alias("file"))
    file = F.col("file")
    prints = files.unionByName(lines).groupBy(*COLLECTION, "location").agg(fingerprint("rel", "size_bytes", where=file).alias("files"), fingerprint("rel", "digest", "algo", where=~file).alias("lines"), fingerprint("rel", where=file).alias("held"), fingerprint("rel", where=~file).alias("listed"))
    copies = prints.groupBy(*COLLECTION).agg(F.collect_list(F.struct("location", "files", "lines", (F.col("listed") == F.col("held")).alias("whole"))).alias("copies"))
    own = diff.of(F.col("copies"), F.col("ref"))
    clean = lambda c: c["whole"] | (c["lines"]["n"] == 0)

    def same(t):
        c = diff.of(F.col("copies"), t["dst"])
        agree = (c["lines"] == own["lines"]) | (c["lines"]["n"] == 0) | (own["lines"]["n"] == 0)
        return F.when(t["held"], (c["files"] == own["files"]) & agree & clean(c)).otherwise(c.isNull())

    alike = clean(own) & F.forall("targets", same)
    return _facts(inv, loc).join(copies, COLLECTION, "left").where(~F.coalesce(alike, F.lit(False))).select(*COLLECTION)


def only_copies(inv: DataFrame, loc: DataFrame) -> DataFrame:
    """Collections whose reference copy has no other copy at an archive in scope (kind only_copy), or where
    some archive in scope lacks the collection altogether (collection_missing), or none is in scope (no_destination)."""
    n_held = F.size(F.filter("targets", lambda t: t["held"])).cast("long")
    counted = _facts(inv, loc).select(*COLLECTION, "ref", F.size("targets").cast("long").alias("n_scope"), n_held.alias("n_held"))
    kind = F.when(F.col("n_scope") == 0, "no_destination").when(F.col("n_held") == 0, "only_copy").when(F.col("n_held") < F.col("n_scope"), "collection_missing")
    return counted.withColumn("kind", kind).where("kind IS NOT NULL").select(*COLLECTION, "ref", "kind", "n_scope", "n_held")


def check(inv: DataFrame, man: DataFrame, loc: DataFrame, years: list[int] | None = None, reference: str = "first", numbers: list[int] | None = None, work: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings, and their summary for every collection that has a reference copy, those that pass included.

    numbers narrows the check to the collections they resolve to, in each of the years. A number that leads to no
    collection is in transfer.unresolved, as nothing can be checked for it.

    With work, a folder, collections are first compared by fingerprints (open_collections, written there): only the
    files of those that differ are shuffled, which pays where most copies are alike. Findings are the same.
    """
    if years:
        inv, man = (df.where(F.col("year").isin(*years)) for df in (inv, man))
    if numbers:
        wanted = selection.numbered(inv, numbers)
        inv, man = (df.join(wanted, COLLECTION, "left_semi") for df in (inv, man))
    facts = _facts(inv, loc)
    if work is None or reference != "first":
        found = findings(inv, man, loc, reference, facts=facts)
    else:
        open_collections(inv, man, loc).write.mode("overwrite").parquet(f"{work}/open")
        among = locations.small(inv.sparkSession.read.parquet(f"{work}/open"), OPEN)
        found = findings(inv, man, loc, reference, among, facts)
    return found, reporting.check_summary(found, facts)


def missing_summary(inv: DataFrame, loc: DataFrame) -> DataFrame:
    """Files of each collection that are missing from each archive in scope, counted; an archive without the
    collection lacks all of them."""
    nothing = inv.select(*KEY, "location", "role", F.lit(None).cast("string").alias("digest")).limit(0)
    files = diff.side_by_side(inv, nothing).join(_facts(inv, loc), COLLECTION)
    lacking = F.filter(F.transform("targets", lambda t: t["dst"]), lambda d: diff.of(F.col("held"), d).isNull())
    return files.where(diff.of(F.col("held"), F.col("ref")).isNotNull()).select(*COLLECTION, F.explode(lacking).alias("location")).groupBy(*COLLECTION, "location").agg(F.count("*").alias("n_missing"))
