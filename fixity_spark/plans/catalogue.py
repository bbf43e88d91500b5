"""Reports over the whole catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixity_spark.functions.paths import is_numbered
from fixity_spark.functions.values import fmt_size
from fixity_spark.operators import locations, reporting
from fixity_spark.schema import COLLECTION
from fixity_spark.scratch import written


def catalogue(inv: DataFrame, man: DataFrame, loc: DataFrame, years: list[int] | None = None, numbered_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """Size and state per location of each collection, and totals."""
    if years:
        inv, man = (df.where(F.col("year").isin(*years)) for df in (inv, man))
    if numbered_only:
        inv = inv.where(is_numbered(F.col("slug")))
    scan = written(reporting.collection_scan(inv, man), "scan")  # a row per copy of a collection, read for each use
    sizes = reporting.collection_size(scan).withColumn("size", fmt_size(F.col("bytes")))
    return sizes.join(reporting.presence_matrix(scan, loc), COLLECTION), reporting.catalogue_totals(sizes)


def status(inv: DataFrame, man: DataFrame, loc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How full each location is, and where every folder is present."""
    return locations.utilisation(loc), reporting.presence_matrix(reporting.collection_scan(inv, man), loc)
