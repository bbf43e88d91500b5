"""Names and paths: junk, visibility, numbering, stems and flat names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that network storage and desktop systems leave behind.
JUNK_SUFFIX = "@SynoResource"
JUNK_DIRS = ("@eaDir", "@tmp")
JUNK_FILES = ("Thumbs.db", "desktop.ini")
JUNK_PREFIX = "._"

#: Numbers that one range of a selection may span.
RANGE_CAP = 500


def junk_dir(name: Column) -> Column:
    return name.endswith(JUNK_SUFFIX) | name.isin(*JUNK_DIRS)


def junk_file(name: Column) -> Column:
    return name.endswith(JUNK_SUFFIX) | name.isin(*JUNK_FILES) | name.startswith(JUNK_PREFIX)


def is_junk(name: Column, is_dir: bool | Column) -> Column:
    """whether a file or folder of this name is left behind by a system."""
    if isinstance(is_dir, bool):
        return junk_dir(name) if is_dir else junk_file(name)
    return F.when(is_dir, junk_dir(name)).otherwise(junk_file(name))


def parts(rel: Column) -> Column:
    return F.split(rel, "/")


def base_name(rel: Column) -> Column:
    return F.element_at(parts(rel), -1)


def parent(rel: Column) -> Column:
    """Folder part, empty for a file at the top."""
    return F.when(F.instr(rel, "/") > 0, F.regexp_extract(rel, "^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def top(rel: Column) -> Column:
    return F.substring_index(rel, "/", 1)


def extension(rel: Column) -> Column:
    """The extension with its dot, empty where there is none."""
    return F.regexp_extract(base_name(rel), r"(\.[^.]*)$", 1)


def stem(rel: Column) -> Column:
    return F.regexp_replace(base_name(rel), r"\.[^.]*$", "")


def visible(rel: Column) -> Column:
    """no component is hidden or junk."""
    hidden_or_junk_dir = F.exists(parts(rel), lambda c: c.startswith("."))
    inner = F.slice(parts(rel), F.lit(1), F.greatest(F.size(parts(rel)) - 1, F.lit(0)))
    return ~hidden_or_junk_dir & ~F.exists(inner, junk_dir) & ~junk_file(base_name(rel))


def manifest_path_is_junk(rel: Column) -> Column:
    """junk by name alone; names that begin with a dot are kept unless they are junk."""
    inner = F.slice(parts(rel), F.lit(1), F.greatest(F.size(parts(rel)) - 1, F.lit(0)))
    return F.exists(inner, junk_dir) | junk_file(base_name(rel))


def number(slug: Column) -> Column:
    """Number before the first underscore; null where there is none. Any count of digits is read."""
    pieces = F.split(slug, "_", 2)
    return F.when(F.size(pieces) == 2, F.element_at(pieces, 1).try_cast("int"))


def is_numbered(slug: Column) -> Column:
    """F4."""
    return F.coalesce(number(slug) > 0, F.lit(False))


def has_number(slug: Column, n: Column | int) -> Column:
    """the slug begins with the number padded to three digits."""
    return slug.startswith(F.format_string("%03d_", n if isinstance(n, Column) else F.lit(n)))


def is_year(name: Column) -> Column:
    """the name of a year folder of this century."""
    return F.coalesce((F.length(name) == 4) & name.try_cast("int").between(2000, 2099), F.lit(False))


def slug(n: Column, name: Column) -> Column:
    """Three-digit number and name, blanks turned to underscores."""
    return F.format_string("%03d_%s", n.cast("int"), F.replace(F.trim(name), F.lit(" "), F.lit("_")))


def slug_name(slug_: Column) -> Column:
    return F.element_at(F.split(slug_, "_", 2), -1)


def clip_stem(name: Column) -> Column:
    """Base name without extension and without a trailing M and digits."""
    return F.regexp_replace(stem(name), r"M[0-9]+$", "")


def flat_name(rel: Column) -> Column:
    """The folder, with underscores for slashes, before the base name."""
    return F.when(parent(rel) == "", base_name(rel)).otherwise(F.concat_ws("_", F.replace(parent(rel), F.lit("/"), F.lit("_")), base_name(rel)))


def normalise_name(name: Column) -> Column:
    """X12."""
    return F.lower(F.trim(name))


def under_prefix(rel: Column, sub: str) -> Column:
    """below the folder sub."""
    return rel.startswith(sub.strip("/") + "/")


def depth(rel: Column) -> Column:
    return F.size(parts(rel)) - 1


def ancestors(rel: Column) -> Column:
    """Every folder above a file, outermost first."""
    p = parts(rel)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), lambda i: F.concat_ws("/", F.slice(p, F.lit(1), i)))


def expand_selection(text: Column) -> Column:
    """the numbers of a selection such as "42-44,48", sorted, each once.

    Fails on an empty selection, a number below 1, a reversed range and a range of more than RANGE_CAP.
    """
    bad = lambda what, item: F.raise_error(F.concat(F.lit(f"selection: {what}: "), item)).cast("int")

    def numbers(item: Column) -> Column:
        ends = F.transform(F.split(item, "-", 2), lambda x: F.trim(x).try_cast("int"))
        low, high = F.element_at(ends, 1), F.element_at(ends, -1)
        checked = (
            F.when(low.isNull() | high.isNull() | (low < 1), bad("not a number from 1 up", item))
            .when(high < low, bad("reversed range", item))
            .when(high - low >= RANGE_CAP, bad(f"more than {RANGE_CAP} numbers", item))
            .otherwise(low)
        )
        return F.sequence(checked, high)

    items = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    items = F.when(F.size(items) > 0, items).otherwise(F.array(bad("empty", text).cast("string")))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(items, numbers))))
