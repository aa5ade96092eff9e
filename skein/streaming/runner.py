"""Starting streams: state store settings, sinks and run-to-completion."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from skein.session import shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
TICK = "30 seconds"
BATCH_FEEDS = 200


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state lives in RocksDB so that it may outgrow executor memory."""
    spark.conf.set(PROVIDER, ROCKSDB)


def file_stream(spark: SparkSession, folder: str, schema, pattern: str | None = None, max_files: int = 200) -> DataFrame:
    """A bounded-rate stream over arriving parquet files."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def run_to_files(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over everything available and read back what it wrote."""
    spark = stream.sparkSession
    use_rocksdb(spark)
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def poll(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    once: bool = False,
) -> StreamingQuery:
    """The crawl tick: hand every micro-batch of responses to ``handle``."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=TICK)
    return writer.start()
