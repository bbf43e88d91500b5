"""Sizes, digests, states and display values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("KB", "MB", "GB", "TB", "PB", "EB")


def fmt_size(n: Column) -> Column:
    """Bytes below 1024 as they are, else one decimal of the largest unit that fits, ties to even."""
    rows = [(1024**k, unit) for k, unit in enumerate(UNITS, 1)]
    # the largest unit that fits gives divisor and suffix, so that the value is formatted once
    divisor = F.element_at(F.array(*(F.lit(float(d)) for d, _ in rows)), fitting := sum((F.when(n >= F.lit(d), 1).otherwise(0) for d, _ in rows[1:]), F.lit(1)))
    suffix = F.element_at(F.array(*(F.lit(u) for _, u in rows)), fitting)
    return F.when(n < 1024, F.format_string("%dB", n.cast("long"))).otherwise(F.format_string("%.1f%s", F.bround(n.cast("double") / divisor, 1), suffix))


def short_hash(digest: Column) -> Column:
    """X11."""
    return F.substring(digest, 1, 8)


def content_digest(content: Column, algo: str = "sha256") -> Column:
    """Digest of stored content, lower-case hex."""
    return F.md5(content) if algo == "md5" else F.sha2(content, 256)


def used_ratio(total: Column, avail: Column) -> Column:
    """Share of a location in use, 1 at most, 0 where the size is unknown."""
    return F.when(total == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), (total - avail) / F.when(total != 0, total)))


def location_name(volume: Column, path: Column) -> Column:
    """The volume, else the last part of the path."""
    return F.coalesce(F.nullif(volume, F.lit("")), F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1))


def base_path(volume: Column, path: Column) -> Column:
    """The path given, else the mount point of the volume."""
    return F.coalesce(F.nullif(path, F.lit("")), F.concat(F.lit("/Volumes/"), volume))


def cell_state(mounted: Column, files: Column, covered: Column) -> Column:
    """Unknown, absent, present or checksummed."""
    return F.when(~mounted, "unknown").when(F.coalesce(files, F.lit(0)) == 0, "absent").when(covered, "checksummed").otherwise("present")
