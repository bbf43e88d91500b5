"""A folder for tables that a query writes: below spark.checkpoint.dir, which all machines share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all runs on this machine (tests), a folder of our own.

    On a cluster a local folder would be another one on each machine, so there the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="spark-fixity-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder, removed when the application ends."""
    folder = f"{shared_root(spark)}/fixity-{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in a new folder: made once, however often it is used, and of a size that joins know."""
    folder = f"{work_folder(df.sparkSession, name)}/rows"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def put_dealt(df: DataFrame, folder: str, by: list[str], buckets: int) -> None:
    """Writes df to a new folder, dealt by some columns as Spark's shuffles deal: a bucketed table that no catalogue keeps."""
    name = _table_name()
    try:
        df.write.bucketBy(buckets, *by).sortBy(*by).option("path", _qualified(df.sparkSession, folder)).option("compression", "zstd").saveAsTable(name)
    finally:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")  # its rows stay, as the folder is not the catalogue's


def get_dealt(spark: SparkSession, folder: str, schema: T.StructType, by: list[str], buckets: int) -> DataFrame:
    """Rows written by put_dealt: what groups or joins them by these columns finds them together, without a shuffle."""
    name, quoted = _table_name(), ", ".join(f"`{c}`" for c in by)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    place = _qualified(spark, folder).replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({quoted}) SORTED BY ({quoted}) INTO {buckets} BUCKETS LOCATION '{place}'")
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def shuffle_buckets(spark: SparkSession) -> int:
    """As many buckets as shuffles have partitions, so that rows that lie dealt are written where they are."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written_dealt(df: DataFrame, name: str, by: list[str], buckets: int | None = None) -> DataFrame:
    """df as a table in a new folder, dealt by some columns; to as many buckets as shuffles have partitions, if not told."""
    folder, buckets = f"{work_folder(df.sparkSession, name)}/rows", buckets or shuffle_buckets(df.sparkSession)
    put_dealt(df, folder, by, buckets)
    return get_dealt(df.sparkSession, folder, df.schema, by, buckets)


@contextlib.contextmanager
def joined_where_dealt(spark: SparkSession):
    """While it lasts, joins take rows where they lie if both sides are dealt alike by some of the keys; Spark else deals both
    by all of them. What is to gain from it has to run within."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _table_name() -> str:
    return f"spark_catalog.default.fixity_{uuid.uuid4().hex}"


def _qualified(spark: SparkSession, folder: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def move(spark: SparkSession, old: str, new: str) -> None:
    """Renames a folder within one file system; fails where that is not done."""
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (old, new))
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(new.getParent())
    if not fs.rename(old, new):
        raise OSError(f"cannot move {old} to {new}")


def drop(spark: SparkSession, folder: str) -> None:
    """Removes a folder with what is in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def folders(spark: SparkSession, folder: str) -> list[str]:
    """Names of what is in a folder; none where it is not there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
