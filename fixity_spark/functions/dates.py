"""Dates of footage: from sidecars, probe output, file names and modification times; seasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fixity_spark.functions.paths import base_name
from fixity_spark.schema import PROBE

# The sidecar attribute, file-name patterns, and seasons in order.
SIDECAR_DATE = r'<CreationDate value="([\s\S]{10})'
DASHED = r"([0-9]{4})[_-]([0-9]{2})[_-]([0-9]{2})"
PACKED = r"(?:^|[^0-9])([0-9]{4})([0-9]{2})([0-9]{2})(?:[^0-9]|$)"
SEASONS = ("Spring", "Summer", "Autumn", "Winter")


def sidecar_date(xml: Column) -> Column:
    """The day in a sidecar's creation attribute; null where there is none or it is no date."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(xml, SIDECAR_DATE, 1), F.lit("")), F.lit("yyyy-MM-dd")).cast("date")


def _day(digits: Column) -> Column:
    """The day of eight digits, which every cast takes; null where they are none of 1990 to 2100."""
    y, m, d = (F.substring(digits, at, n).cast("int") for at, n in ((1, 4), (5, 2), (7, 2)))
    # a day past the month's end runs into the next month
    return F.when(y.between(1990, 2100) & m.between(1, 12) & d.between(1, 31), F.date_add(F.make_date(y, F.when(m.between(1, 12), m), F.lit(1)), d - 1))


def filename_date(rel: Column) -> Column:
    """The date in a file's name, dashed form first, then eight digits on their own; null where none fits.

    Both forms become eight digits of one array, so that each pattern runs once and the expression stays small
    wherever it is used.
    """
    name = base_name(rel)
    # no match is null, not an empty string: a failing cast costs an exception a row
    found = F.array(*(F.nullif(F.regexp_replace(F.regexp_extract(name, p, 0), "[^0-9]", ""), F.lit("")) for p in (DASHED, PACKED)))
    return F.try_element_at(F.filter(F.transform(found, _day), lambda d: d.isNotNull()), F.lit(1))


def probe_date(output: Column) -> Column:
    """Creation time in probe output, of the container, else of the first stream that has one."""
    p = F.from_json(output, PROBE)
    tags = F.concat(F.array(p["format"]["tags"]), F.coalesce(F.transform(p["streams"], lambda s: s["tags"]), F.array().cast("array<map<string,string>>")))
    times = F.transform(tags, lambda t: F.try_to_timestamp(F.element_at(t, "creation_time")))
    return F.try_element_at(F.filter(times, lambda t: t.isNotNull()), F.lit(1))


def shot_date(probe: Column, rel: Column, mtime: Column, allow_mtime: bool = True) -> tuple[Column, Column]:
    """Date and where it comes from: probe, filename, mtime or none."""
    named, changed = filename_date(rel), F.to_date(mtime) if allow_mtime else F.lit(None).cast("date")
    day = F.coalesce(F.to_date(probe), named, changed)
    source = F.when(probe.isNotNull(), "probe").when(named.isNotNull(), "filename").when(changed.isNotNull(), "mtime").otherwise("none")
    return day, source


def season(day: Column) -> Column:
    """Spring to Winter by month; December joins the winter of its own year folder."""
    of_month = F.array(*(F.lit(SEASONS[(m // 3 + 3) % 4]) for m in range(1, 13)))
    return F.try_element_at(of_month, F.month(day))  # null where there is no day


def season_order(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEASONS)), name).cast("int")


def local_year(mtime: Column) -> Column:
    """Year of the day in the session's time zone."""
    return F.year(F.to_date(mtime))
