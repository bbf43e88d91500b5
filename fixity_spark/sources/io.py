"""Where inventories, manifests and their companions come from and go to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fixity_spark.functions.paths import visible
from fixity_spark.functions.values import base_path, location_name
from fixity_spark.operators.diff import drop_self_entry
from fixity_spark.schema import CONFIG, KEY, PROBE

#: <root>/<year>/<slug>/<rel>
_PLACE = r"/([0-9]{4})/([^/]+)/(.+)$"


def _place(path: Column, encoded: bool = False) -> dict[str, Column]:
    """Year, slug and rel of a path; paths in _metadata are URL-encoded, others are not."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))) if encoded else path
    return {"year": F.regexp_extract(decoded, _PLACE, 1).try_cast("int"), "slug": F.regexp_extract(decoded, _PLACE, 2), "rel": F.regexp_extract(decoded, _PLACE, 3)}


def read_inventory(spark: SparkSession, path: str, location: str) -> DataFrame:
    """Files under path/<year>/<slug>/, without junk and hidden ones; content is never read.

    Spark's file listing skips names that begin with an underscore or a dot; use tree.read_tree where those matter.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    rows = files.select(*[c.alias(k) for k, c in _place(F.col("path")).items()], F.lit(location).alias("location"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"))
    return drop_self_entry(rows.where("year IS NOT NULL")).where(visible(F.col("rel")))


def inventory_from_table(df: DataFrame, mapping: dict[str, str], keep_hidden: bool = False) -> DataFrame:
    """An inventory from a listing table; mapping names an SQL expression for each inventory column."""
    rows = df.select(*[F.expr(e).alias(k) for k, e in mapping.items()])
    return rows if keep_hidden else drop_self_entry(rows).where(visible(F.col("rel")))


def collection_files(inv: DataFrame, man: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S3: listing without the manifest itself, and the number of ghosts of each collection and location."""
    from fixity_spark.operators.diff import ghosts

    return drop_self_entry(inv), ghosts(inv, man).groupBy("year", "slug", "location").agg(F.count("*").alias("n_ghosts"))


def parse_manifest_line(line: Column) -> Column:
    """Struct of digest and rel of a line; null where it holds no two spaces. The path may hold more of them."""
    gap = F.instr(line, "  ")
    return F.when(gap > 0, F.struct(F.substring(line, F.lit(1), gap - 1).alias("digest"), F.substring(line, gap + 2, F.length(line)).alias("rel")))


def _packed(digest: Column) -> Column:
    """A digest in half its bytes where it is written as hex digits are, for the way through a shuffle."""
    half = F.unhex(digest)  # null where other characters are in it
    return F.when(F.lower(F.hex(half)) == digest, F.concat(F.lit(b"\x01"), half)).otherwise(F.concat(F.lit(b"\x00"), digest.cast("binary")))


def _unpacked(packed: Column) -> Column:
    rest = F.substring(packed, 2, 2**31 - 1)
    return F.when(F.substring(packed, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def read_manifests(spark: SparkSession, glob: str, location: str, parts: int | None = None) -> DataFrame:
    """Rows of the manifests that glob names, each at <year>/<slug>/; of a repeated path the last line holds. With parts,
    the rows come dealt by path (KEY) to so many.

    A manifest of any size is read line by line, in as many tasks as its bytes make. Lines are in order of the byte where
    their task's part of the file begins, then of reading, so the last one is known without the file being in one place.
    """
    place = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(glob).select(parse_manifest_line(F.col("value")).alias("x"), place["file_path"].alias("path"), F.struct(place["file_block_start"].alias("at"), F.monotonically_increasing_id().alias("k")).alias("order"))
    rows = lines.where("x IS NOT NULL").select(*[c.alias(k) for k, c in _place(F.col("path"), encoded=True).items() if k != "rel"], F.col("x.rel").alias("rel"), _packed(F.col("x.digest")).alias("digest"), "order")
    # dealt before they are grouped: grouping them first would sort all lines and find next to nothing to merge
    dealt = rows.repartition(*([] if parts is None else [parts]), *KEY)
    last = dealt.groupBy(*KEY).agg(F.max_by("digest", "order").alias("digest")).withColumn("digest", _unpacked(F.col("digest")))
    return drop_self_entry(last.withColumn("location", F.lit(location)))


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    """Locations in file order; size and room are not in the file and come as null."""
    rows = spark.read.schema(CONFIG).json(path, multiLine=True).select(F.posexplode("drives").alias("ord", "d"))
    d = F.col("d")
    return rows.select("ord", location_name(d["volume"], d["path"]).alias("name"), base_path(d["volume"], d["path"]).alias("base"), d["root"].alias("root"), d["role"].alias("role"), d["pull"].alias("pull"), F.coalesce(d["year_from"], F.lit(0)).alias("year_from"), F.coalesce(d["year_to"], F.lit(0)).alias("year_to"))


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """Last number of each year; a key that is no year fails."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,int>")).alias("k", "last_num"))
    year = F.coalesce(F.col("k").try_cast("int"), F.raise_error(F.concat(F.lit("not a year: "), F.col("k"))).cast("int"))
    return rows.select(year.alias("year"), "last_num")


def read_sidecars(spark: SparkSession, glob: str, card: str) -> DataFrame:
    """(card, name, xml) of sidecar files."""
    rows = spark.read.text(glob, wholetext=True).select(F.col("value").alias("xml"), F.col("_metadata.file_name").alias("name"))
    return rows.select(F.lit(card).alias("card"), "name", "xml")


def parse_probe(df: DataFrame, col: str) -> DataFrame:
    """Adds probe, the parsed form of captured probe output."""
    return df.withColumn("probe", F.from_json(col, PROBE))


def write_manifests(df: DataFrame, path: str) -> None:
    """One folder of sorted manifest lines per (year, location, slug)."""
    lines = drop_self_entry(df).select("year", "location", "slug", F.format_string("%s  %s", "digest", "rel").alias("value"))
    lines.repartition("year", "location", "slug").sortWithinPartitions("year", "location", "slug", "value").write.mode("overwrite").partitionBy("year", "location", "slug").text(path)


def read_written_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Rows that write_manifests wrote."""
    rows = spark.read.schema("value string, year int, location string, slug string").text(path)
    pair = F.split("value", "  ", 2)
    return rows.where(F.size(pair) == 2).select("year", "slug", "location", F.element_at(pair, 2).alias("rel"), F.element_at(pair, 1).alias("digest"))


def write_counters(df: DataFrame, path: str) -> None:
    """Replaces the counter table."""
    df.select("year", "last_num").coalesce(1).write.mode("overwrite").parquet(path)


def write_findings(df: DataFrame, path: str) -> None:
    """A report or plan, dealt by year and sorted by its other columns within a file, files in order of them."""
    rest = [c for c in ("slug", "location", "kind", "rel") if c in df.columns]
    df.repartitionByRange("year", *rest).sortWithinPartitions("year", *rest).write.mode("overwrite").partitionBy("year").parquet(path)


__all__ = ["collection_files", "inventory_from_table", "parse_manifest_line", "parse_probe", "read_counters", "read_inventory", "read_locations", "read_manifests", "read_sidecars", "read_written_manifests", "write_counters", "write_findings", "write_manifests"]
