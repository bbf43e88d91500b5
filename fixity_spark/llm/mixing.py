"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fixity_spark.llm.common import Scratch, own_names
from fixity_spark.llm.words import word_counts

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: A target stops at this many times its source's size, and a document at as many copies.
MOST = 3
#: The prefix sums of a source run over 16 ** DIGITS ranges in each size class, by hash of the id: however ids are
#: spread, the documents of a class fall into all of them.
DIGITS = 3
SEED = "mix"

_BITS = "length(bin(size))"
#: Eight classes for each doubling of size, in size order.
SIZE_CLASS = f"{_BITS} * 8 + (shiftright(size, greatest({_BITS} - 4, 0)) & 7)"


def _sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(word_counts(b.columns[-1]), pa.int64())], [*b.schema.names[:-1], "size"])


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds rank and target to sources(source, source_size).

    The sizes' total is shared by weight; a target stops at most times its source's size and the excess is
    reshared by weight until none is above. That fixed point is a water level: taken in order of cap over
    weight, sources are capped until one fits under the level of those that remain. The table has one row
    per source, so its windows are small whatever the corpus holds.
    """
    cycle = F.array(*map(F.lit, weights))
    ranked = sources.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * most)
    whole = W.partitionBy()
    before = W.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    fitted = ranked.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
    shared = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(whole)["level"]
    return fitted.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * shared)).select("source", "source_size", "rank", "target")


def mix_decisions(docs: DataFrame, key: list[str], weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, scratch: Scratch | None = None) -> DataFrame:
    """key columns, doc_id, source, size, source_size, target and copies, one row per row of docs.

    Each document of a source expects target / source_size copies. Documents are ordered within their source
    by size class, range, size and id; the expected copies are summed along that order from one random
    offset per source, and a document is emitted once per integer boundary its share crosses. The order by size
    makes the words taken follow the target closely. The sum is a prefix count over (source, class, range)
    cells plus a rank within the cell, so no task holds a whole source.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    keys = [F.col(k).alias(f"_fx_{k}") for k in key]
    narrow = docs.select(*keys, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").alias("_fx_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]] + ["size long"])
    sized = scratch.write(narrow.mapInArrow(_sizes, schema), "sized")
    stats = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = scratch.write(targets(stats, weights, most), "targets")
    # rank stands for the source from here on
    goal = goal.withColumn("_fx_s", F.col("source")).drop("source")
    placed = sized.join(goal, F.col("source").eqNullSafe(F.col("_fx_s"))).drop("_fx_s")
    placed = placed.withColumn("class", F.expr(SIZE_CLASS)).withColumn("span", F.coalesce(F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, DIGITS), 16, 10).cast("long"), F.lit(0).cast("long")))
    placed = scratch.write(placed, "placed")
    cell = ["rank", "class", "span"]
    counts = placed.groupBy(*cell).agg(F.count("*").alias("n"))
    # prefix sums over the few classes of a source, and within a class over its ranges
    upto = lambda by, order: F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    classes = counts.groupBy("rank", "class").agg(F.sum("n").alias("n")).select("rank", "class", upto(["rank"], "class").alias("before"))
    starts = counts.withColumn("inside", upto(["rank", "class"], "span")).join(classes, ["rank", "class"]).select(*cell, (F.col("before") + F.col("inside")).alias("start"))
    within = W.partitionBy(*cell).orderBy("size", "doc_id")
    k = F.col("start") + F.row_number().over(within)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 5), 16, 10).cast("double") / (1 << 20)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    numbered = placed.join(starts, cell).withColumn("k", k).withColumn("rate", rate).withColumn("u", offset)
    copies = F.floor(F.col("u") + F.col("rate") * F.col("k")) - F.floor(F.col("u") + F.col("rate") * (F.col("k") - 1))
    return numbered.select(*[F.col(f"_fx_{x}").alias(x) if x not in ("doc_id", "source") else x for x in key], *[c for c in ("doc_id", "source") if c not in key], "size", "source_size", "target", F.least(copies, F.lit(most)).cast("long").alias("copies"))


def mix_report(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, copies, taken.

    A null or empty text has size 0 and takes no words; a null source is a source of its own, last in order.
    Rows repeated with the same id are documents of their own. An empty table gives no rows.
    """
    return mix_decisions(docs, []).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


@own_names
def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """docs with each row repeated as often as the mix takes it (not at all for 0), every column kept."""
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.write(docs.withColumn("_fx_row", F.monotonically_increasing_id()), "rows")
    decided = mix_decisions(rows.select("_fx_row", "doc_id", "source", "text"), ["_fx_row"], weights, most, seed, scratch)
    taken = decided.where("copies > 0").select("_fx_row", F.col("copies").alias("_fx_copies"))
    # most documents are taken, so their keys are never a small side: the plan is the same at every size
    out = rows.join(taken.hint("merge"), "_fx_row").withColumn("_fx_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_fx_copies")))
    return out.select(*docs.columns)


ORACLE_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), stats AS (
  SELECT source, sum(size)::BIGINT AS source_size, {MOST} * sum(size)::BIGINT AS cap, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source
), weighed AS (SELECT *, (rank - 1) % {len(WEIGHTS)} + 1 AS weight FROM stats
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER p, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0))::DOUBLE AS level
  FROM weighed WINDOW p AS (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
  SELECT source, source_size, CASE WHEN cap <= weight * level THEN cap::DOUBLE ELSE
    weight * (SELECT arg_min(level, rank) FROM (SELECT * FROM levels WHERE cap > weight * level ORDER BY cap::DOUBLE / weight, rank LIMIT 1)) END AS target FROM levels
), placed AS (
  SELECT d.doc_id, d.source, d.size, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN least(g.target / g.source_size, {float(MOST)}) ELSE 0 END AS rate,
    CAST('0x' || substr(md5('{SEED}:' || coalesce(d.source, '')), 1, 5) AS BIGINT) / 1048576.0 AS u,
    row_number() OVER (PARTITION BY d.source ORDER BY length(bin(d.size)) * 8 + ((d.size >> greatest(length(bin(d.size)) - 4, 0)) & 7),
      CAST('0x' || substr(md5(d.doc_id::VARCHAR), 1, {DIGITS}) AS BIGINT), d.size, d.doc_id) AS k
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
), taken AS (SELECT *, least(floor(u::DOUBLE + rate * k) - floor(u::DOUBLE + rate * (k - 1)), {MOST})::BIGINT AS copies FROM placed)
SELECT doc_id, source, size, source_size, target, copies, size * copies AS taken FROM taken
"""
