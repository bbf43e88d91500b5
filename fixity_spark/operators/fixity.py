"""Digests of stored content against manifests, agreement of copies and manifest merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixity_spark.functions.values import content_digest
from fixity_spark.operators.diff import algo, drop_self_entry
from fixity_spark.schema import KEY


def digests(content: DataFrame, column: str = "content", kind: str = "sha256") -> DataFrame:
    """Content rows with digest and algo in place of the content."""
    return content.withColumn("digest", content_digest(F.col(column).cast("binary"), kind)).withColumn("algo", F.lit(kind)).drop(column)


def chunked_digests(chunks: DataFrame, chunk_bytes: int) -> DataFrame:
    """Digest of files kept as rows (key, location, chunk_no, content): that of their chunk digests in order.

    For files beyond what one binary value holds. Chunks are digested where they are; only digests are gathered.
    """
    each = chunks.select(*KEY, "location", "chunk_no", F.sha2("content", 256).alias("d"))
    parts = F.array_sort(F.collect_list(F.struct("chunk_no", "d")))
    return each.groupBy(*KEY, "location").agg(F.sha2(F.concat_ws("", F.transform(parts, lambda x: x["d"])), 256).alias("digest")).withColumn("algo", F.lit(f"sha256-chunked-{chunk_bytes}"))


#: Chunks, or nodes, below a node of a tree of digests.
FANOUT = 256


def chunk_digests(chunks: DataFrame) -> DataFrame:
    """Digest of each chunk (key, location, chunk_no, content), where it lies: key, location, level 0, node, digest."""
    return chunks.select(*KEY, "location", F.lit(0).alias("level"), F.col("chunk_no").cast("long").alias("node"), F.sha2("content", 256).alias("digest"))


def digest_tree(leaves: DataFrame, levels: int, fanout: int = FANOUT) -> DataFrame:
    """H3: all nodes of the trees over leaves (chunk_digests), level by level: the digest of a node is that of the digests
    below it in order, with their numbers, so a chunk that is missing changes it, too.

    levels is chosen by the caller so that fanout ** levels is at least the number of chunks of the longest file; every
    file's root is its node 0 at that level. A group holds at most fanout digests.
    """
    level, out = leaves, leaves
    for k in range(1, levels + 1):
        below = F.array_sort(F.collect_list(F.struct("node", "digest")))
        text = F.concat_ws("", F.transform(below, lambda x: F.concat(x["node"].cast("string"), F.lit(":"), x["digest"], F.lit(";"))))
        level = level.groupBy(*KEY, "location", F.expr(f"node div {fanout}").alias("_up")).agg(F.sha2(text, 256).alias("digest")).select(*KEY, "location", F.lit(k).alias("level"), F.col("_up").alias("node"), "digest")
        out = out.unionByName(level)
    return out


def damaged_chunks(good: DataFrame, other: DataFrame, levels: int, fanout: int = FANOUT) -> DataFrame:
    """(key, location, chunk_no, problem) of the chunks of other's files that differ from good's trees.

    good (key, level, node, digest) is one tree of each file, other has one for each location. Roots are compared first,
    then, level by level, only the nodes below those that differ: what is read of the trees follows the damage. problem:
    `differs`, `missing` (other lacks the chunk) or `extra`. Files that other lacks altogether are no damage but J1.
    """
    at = lambda df, k: df.where(F.col("level") == k)
    files = at(other, levels).select(*KEY, "location", F.col("node").alias("_up")).distinct()
    open_ = files
    for k in range(levels, -1, -1):
        if k < levels:
            up = F.expr(f"node div {fanout}").alias("_up")
        else:
            up = F.col("node").alias("_up")
        one = at(good, k).select(*KEY, up, "node", F.col("digest").alias("_a")).join(open_, [*KEY, "_up"])
        two = at(other, k).select(*KEY, "location", up, "node", F.col("digest").alias("_b")).join(open_, [*KEY, "location", "_up"], "left_semi")
        both = one.join(two, [*KEY, "location", "_up", "node"], "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
        open_ = both.select(*KEY, "location", F.col("node").alias("_up")).distinct()
    problem = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").otherwise("differs")
    return both.select(*KEY, "location", F.col("node").alias("chunk_no"), problem.alias("problem"))


def repair_plan(damage: DataFrame, src: str) -> DataFrame:
    """The chunks to copy from src so that the files are whole again; extra chunks are to be dropped, not copied."""
    return damage.select(*KEY, F.lit(src).alias("src"), F.col("location").alias("dst"), "chunk_no", F.when(F.col("problem") == "extra", "drop").otherwise("copy").alias("action"))


def verify(man: DataFrame, computed: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Status of each manifest row: ok, mismatch, or unreadable where there is no content.

    Rows are only compared under the same algorithm, where both sides name one; others are `other_algo`.
    """
    key = key or [*KEY, "location"]
    named = "algo" in man.columns and "algo" in computed.columns
    found = computed.select(*key, F.col("digest").alias("actual"), *([F.col("algo").alias("actual_algo")] if named else []))
    rows = (drop_self_entry(man) if "rel" in man.columns else man).join(found, key, "left")
    other = (F.col("algo") != F.col("actual_algo")) if named else F.lit(False)
    status = F.when(F.col("actual").isNull(), "unreadable").when(other, "other_algo").when(F.col("digest") == F.col("actual"), "ok").otherwise("mismatch")
    return rows.withColumn("status", status).drop("actual_algo")


def consensus(computed: DataFrame, participants: DataFrame | None = None) -> DataFrame:
    """Per path the digests, copies and whether all agree; a copy without a digest breaks agreement.

    participants (year, slug, n): locations that take part; a path on fewer is not agreed either.
    """
    by_path = computed.groupBy(*KEY).agg(F.count_distinct("digest").alias("n_digests"), F.count("*").alias("n_copies"), F.count("digest").alias("n_read"), F.min("digest").alias("digest"))
    agreed = (F.col("n_digests") == 1) & (F.col("n_read") == F.col("n_copies"))
    if participants is not None:
        by_path = by_path.join(participants.withColumnRenamed("n", "n_expected"), ["year", "slug"])
        agreed &= F.col("n_copies") == F.col("n_expected")
    return by_path.withColumn("agreed", agreed)


def merge_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """One digest per path and location, the newest, with its algorithm where either side names one; self entries go.

    Of repeated new rows the largest digest holds.
    """
    named = ["algo"] if "algo" in old.columns + new.columns else []
    # under names of its own: a union of what is itself made from a union is only known to lie dealt by path where its columns
    # have been renamed since
    own = {k: f"_{k}" for k in (*KEY, "location")}
    part = lambda df, p: drop_self_entry(df).select(*[F.col(k).alias(n) for k, n in own.items()], F.lit(p).alias("p"), "digest", *[algo(df).alias(c) for c in named])
    newest = part(old, 0).unionByName(part(new, 1)).groupBy(*own.values()).agg(F.max(F.struct("p", "digest", *named)).alias("m"))
    return newest.select(*[F.col(n).alias(k) for k, n in own.items()], *[F.col("m")[c].alias(c) for c in ("digest", *named)])


def duplicate_content(computed: DataFrame, key: str = "digest") -> DataFrame:
    """Digests that more than one row has, with their number."""
    return computed.groupBy(key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def verify_summary(checked: DataFrame, by: list[str]) -> DataFrame:
    """Files, locations and failures of each group."""
    return checked.groupBy(*by).agg(F.count("*").alias("n_files"), F.count_distinct("location").alias("n_locations"), F.count_if(F.col("status") != "ok").alias("n_failed"))
