"""Locations: selection, year coverage and expansion to destinations. A location table has tens of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixity_spark.functions.paths import normalise_name
from fixity_spark.functions.values import used_ratio


#: Rows of a location table that are broadcast; a larger one is left to the optimizer.
SMALL = 10_000


def small(dim: DataFrame, most: int = SMALL) -> DataFrame:
    """dim with a broadcast hint where it is known to have at most so many rows."""
    return F.broadcast(dim) if dim.limit(most + 1).count() <= most else dim


def with_room(loc: DataFrame, room: DataFrame) -> DataFrame:
    """Locations of a location file (S5) with mounted, avail_bytes and total_bytes from room(name, avail_bytes,
    total_bytes); a location without a row there is not mounted and has no room."""
    found = small(room.select("name", F.lit(True).alias("mounted"), "avail_bytes", "total_bytes"))
    joined = loc.drop("mounted", "avail_bytes", "total_bytes").join(found, "name", "left")
    return joined.withColumns({"mounted": F.coalesce("mounted", F.lit(False)), **{c: F.coalesce(c, F.lit(0)).cast("long") for c in ("avail_bytes", "total_bytes")}})


def with_location(df: DataFrame, loc: DataFrame) -> DataFrame:
    """Inventory or manifest rows with ord and role of their location, as checks need them; fails on a location that loc
    does not name."""
    known = small(loc.select(F.col("name").alias("location"), F.col("ord").cast("int").alias("ord"), "role"))
    unknown = F.raise_error(F.concat(F.lit("unknown location: "), F.coalesce("location", F.lit("null"))))
    joined = df.drop("ord", "role").join(known, "location", "left")
    return joined.withColumn("ord", F.coalesce("ord", unknown.cast("int"))).select(*[c for c in df.columns if c not in ("ord", "role")], "ord", "role")


def covers_year(year: Column, year_from: Column, year_to: Column) -> Column:
    """whether a location is responsible for a year; 0 and null leave a side open."""
    low, high = F.coalesce(year_from, F.lit(0)), F.coalesce(year_to, F.lit(0))
    return ((low == 0) | (year >= low)) & ((high == 0) | (year <= high))


def select_locations(loc: DataFrame, role: str | None = None, names: list[str] | None = None, pull_only: bool = False, mounted_only: bool = True) -> DataFrame:
    """F8: mounted locations of a role; names (case and outer blanks ignored) override the pull flag."""
    out = loc.where("mounted") if mounted_only else loc
    if role:
        out = out.where(F.col("role") == role)
    if names:
        return out.where(normalise_name(F.col("name")).isin(*(n.strip().lower() for n in names)))
    return out.where(F.coalesce("pull", F.lit(True))) if pull_only else out


#: Years are split into dyadic intervals of 1, 2, 4, ... 2 ** LEVELS years from year 0 on; those outside count as at an end.
LEVELS = 14
_LAST = (1 << LEVELS) - 1


def year_nodes(year: Column) -> Column:
    """The dyadic interval of each size that a year is in: array<struct<level, node>>."""
    held = F.least(F.greatest(year, F.lit(0)), F.lit(_LAST))
    return F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(held, k).alias("node")) for k in range(LEVELS + 1)])


def range_nodes(year_from: Column, year_to: Column) -> Column:
    """The fewest dyadic intervals, at most two of each size, that make up the years from year_from to year_to, either of
    which may be open (0 or null): array<struct<level, node>>. A year in the range is in one of them exactly once."""
    low = F.greatest(F.coalesce(year_from, F.lit(0)), F.lit(0))
    high = F.when(F.coalesce(year_to, F.lit(0)) == 0, F.lit(_LAST)).otherwise(F.least(F.greatest(year_to, F.lit(-1)), F.lit(_LAST))) + 1
    nodes = []
    for k in range(LEVELS + 1):
        left, right = F.shiftright(low + ((1 << k) - 1), k), F.shiftright(high, k)
        odd_left, odd_right = left % 2 == 1, right % 2 == 1
        top = k == LEVELS
        nodes.append(F.when((left < right) & (F.lit(top) | odd_left), F.struct(F.lit(k).alias("level"), left.alias("node"))))
        if not top:
            nodes.append(F.when((left + left % 2 < right) & odd_right, F.struct(F.lit(k).alias("level"), (right - 1).alias("node"))))
    return F.filter(F.array(*nodes), lambda n: n.isNotNull())


def in_range(rows: DataFrame, dim: DataFrame, how: str = "inner") -> DataFrame:
    """rows with each row of dim whose years (_from, _to) cover theirs: an equality join on dyadic intervals, so that no
    size of dim makes it compare all with all. With how `left`, a row comes with nulls once more for each interval that it
    meets nothing in."""
    nodes = small(dim.withColumn("_n", F.explode(range_nodes(F.col("_from"), F.col("_to")))).select("*", F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node")).drop("_n", "_from", "_to"))
    dealt = rows.withColumn("_n", F.explode(year_nodes(F.col("year")))).select("*", F.col("_n.level").alias("_level"), F.col("_n.node").alias("_node")).drop("_n")
    return dealt.join(nodes, ["_level", "_node"], how).drop("_level", "_node")


def scope(coll: DataFrame, loc: DataFrame, role: str = "cold") -> DataFrame:
    """Collections with the mounted locations of a role that cover their year (dst, dst_ord)."""
    dim = select_locations(loc, role).select(F.col("name").alias("dst"), F.col("ord").alias("dst_ord"), F.col("year_from").alias("_from"), F.col("year_to").alias("_to"))
    return in_range(coll, dim).select(*coll.columns, "dst", "dst_ord")


def expand_destinations(src: DataFrame, loc: DataFrame, role: str | None = None, names: list[str] | None = None, in_scope: bool = False) -> DataFrame:
    """Each source row (column src) with every eligible destination but itself (dst, dst_ord)."""
    dim = select_locations(loc, role, names, pull_only=not in_scope)
    dim = dim.select(F.col("name").alias("dst"), F.col("ord").alias("dst_ord"), F.col("year_from").alias("_from"), F.col("year_to").alias("_to"))
    if in_scope:
        return in_range(src, dim).where("src <> dst").select(*src.columns, "dst", "dst_ord")
    # every source goes to every destination: the result is that product
    return src.join(small(dim.drop("_from", "_to")), F.col("src") != F.col("dst"))


def utilisation(loc: DataFrame) -> DataFrame:
    """Bytes used and the share of each mounted location."""
    return loc.where("mounted").select("ord", "name", "role", (F.col("total_bytes") - F.col("avail_bytes")).alias("used_bytes"), "total_bytes", used_ratio(F.col("total_bytes"), F.col("avail_bytes")).alias("used_ratio"))
