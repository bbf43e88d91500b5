"""L1: new listing files are taken in as they come; what was taken in before is skipped."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from fixity_spark.schema import KEY

#: Keeps the state of a stream on local disk, with its changes in the checkpoint, instead of in memory.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Changes go to the checkpoint as a log, not as whole files of the store; a put does not look its key up again to count keys.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def ingest_incremental(spark: SparkSession, listing: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """Appends the rows of new listing files whose (key, location) was not taken in yet, and ends when none is left.

    The keys taken in are the state of the stream, dealt by key and kept in RocksDB: a batch looks up its own keys and
    reads nothing of the target, however large that is. The file sink's log makes a batch that is run again after a
    failure count once; late files are appended whenever they come. The target belongs to the stream: one that holds rows
    of another writer is refused, as their keys are not in the state; give such rows as listing files.
    """
    if _exists(spark, target) and not _exists(spark, f"{target}/_spark_metadata"):
        raise ValueError(f"{target} was not written by this stream")
    if _exists(spark, f"{target}/_spark_metadata") and not _exists(spark, f"{checkpoint}/offsets"):
        raise ValueError(f"{checkpoint} does not hold the state of {target}")
    for name, value in STATE_CONF.items():
        spark.conf.set(name, value)
    stream = spark.readStream.schema(schema).parquet(listing)
    return stream.dropDuplicates([*KEY, "location"]).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
