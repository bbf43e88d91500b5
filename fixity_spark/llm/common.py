"""What the operators of this subpackage share: scratch tables, batch sizes and connected components."""

from __future__ import annotations

import contextlib
import functools
import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch sent to a Python worker.
BATCH_BYTES = 8 << 20


def tune(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes: rows of whole texts differ in size by orders of magnitude."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ship(spark)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, unless PYTHONPATH already leads to it."""
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    out = Path(tempfile.mkdtemp(prefix="spark-fixity-", dir="/tmp")) / "fixity_spark_package.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((root / "fixity_spark").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(out))
    _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share: spark.checkpoint.dir; where it is unset and all runs on this machine (tests), one
    of our own. On a cluster a local folder would be another one on each machine, so there the setting is required."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="spark-fixity-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Tables written in the shared folder for the length of one operator.

    A written table cuts lineage: a lost executor costs its running tasks, nothing upstream. Tables that the
    returned DataFrame reads stay until the application ends; drop() removes others at once.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/fixity-{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.deleteOnExit(path)
        tune(spark)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write(self, df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(table))
        return self.read(table, df)

    def read(self, table: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(table))

    def tidy(self) -> None:
        """Let Spark remove shuffle files of finished steps now; it does so when the driver collects garbage.

        The last query is still referred to until another one runs, so an empty one runs first.
        """
        self.spark.range(1).repartition(1).write.format("noop").mode("overwrite").save()
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, table: str) -> None:
        with contextlib.suppress(Exception):  # a scratch table that stays costs space only
            self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table)), True)


#: What empties the tables that operators keep in a Python worker from task to task.
HELD: list = []


def free_worker() -> None:
    """Empty the tables of operators that this worker ran before; called where another operator's tasks begin."""
    for clear in HELD:
        clear()


def own_names(operator):
    """For operators that keep every column: columns named as those used inside (_fx_...) are renamed on the way."""

    @functools.wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        odd = [c for c in docs.columns if c.lower().startswith("_fx_")]
        names = {c: f"in{k}{'_' * (1 + max(map(len, docs.columns)))}" for k, c in enumerate(odd)}
        out = operator(docs.withColumnsRenamed(names), *args, **kwargs) if odd else operator(docs, *args, **kwargs)
        return out.withColumnsRenamed({v: k for k, v in names.items()}) if odd else out

    return run


def numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs with _fx_row, a number of its own for each row whatever its id; written, as numbers differ when rows are read anew."""
    return scratch.write(docs.withColumn("_fx_row", F.monotonically_increasing_id()), "rows")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """Connected components of edges(a, b) as (node, component), component the smallest node reachable.

    Alternating large-star and small-star steps: each hooks neighbours to the smallest one, and the edge set
    never grows. A hub's rows meet in a join, which adaptive execution can split, never in one group. Each
    round is written to the shared folder; rounds grow with the logarithm of the longest path.
    """
    pair = lambda x, y: edges.select(F.col(x).cast("long").alias("a"), F.col(y).cast("long").alias("b"))
    now = scratch.write(pair("a", "b").where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), f"{name}0")
    seen, k = None, 0
    while True:
        sums = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (sums.n, sums.s) == seen or not sums.n:
            break
        seen = (sums.n, sums.s)
        # large star: each node hands its larger neighbours to the smallest of its neighbourhood
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: each node hands its smaller neighbours, and itself, to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        k += 1
        new = scratch.write(small.where("a <> b").distinct(), f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")
        now = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
