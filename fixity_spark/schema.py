"""Table layouts and fixed names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: File name of the manifest of a collection; it never lists itself.
MANIFEST = "checksums.b3"
#: A file's identity across locations.
KEY = ["year", "slug", "rel"]
COLLECTION = ["year", "slug"]

def require(df: DataFrame, what: str, *columns: str) -> DataFrame:
    """df itself; fails where it lacks a column, as a rule that misses one must not take it for empty."""
    if lacking := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{what} lacks {', '.join(lacking)}; locations.with_location adds ord and role")
    return df


LOCATIONS = "ord int, name string, role string, pull boolean, year_from int, year_to int, mounted boolean, avail_bytes long, total_bytes long"
#: What the readers return; locations.with_location adds ord and role.
INVENTORY = "year int, slug string, location string, rel string, size_bytes long, mtime timestamp"
MANIFEST_ROWS = "year int, slug string, location string, rel string, digest string, algo string"
ARRIVALS = "card string, rel string, stem string, size_bytes long, mtime timestamp"
COUNTERS = "year int, last_num int"
FINDINGS = "year int, slug string, location string, kind string, rel string, ref_digest string, other_digest string"

#: Layout of the location file: unknown keys are ignored, missing ones are null.
CONFIG = T.StructType([
    T.StructField("cards", T.ArrayType(T.StructType([T.StructField("volume", T.StringType()), T.StructField("sub", T.StringType())]))),
    T.StructField("drives", T.ArrayType(T.StructType([
        T.StructField("volume", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("root", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("pull", T.BooleanType()),
        T.StructField("year_from", T.IntegerType()),
        T.StructField("year_to", T.IntegerType()),
    ]))),
])

_TAGS = T.StructType([T.StructField("tags", T.MapType(T.StringType(), T.StringType()))])
#: Layout of captured media-probe output.
PROBE = T.StructType([T.StructField("format", _TAGS), T.StructField("streams", T.ArrayType(_TAGS))])
