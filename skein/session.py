"""Session construction and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on.  Partition counts are left to the cluster
# defaults plus AQE, so nothing here is sized for one machine.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot feed is split even where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A batch of whole pages or texts is bounded by its bytes, not by 10,000 rows alone.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    # A task that writes a few buckets keeps their files open instead of sorting its rows.
    "spark.sql.maxConcurrentOutputFileWriters": "64",
}


def build_session(
    app_name: str = "skein",
    master: str | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Return a session with the settings this library needs."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Set what the library relies on in a session somebody else built."""
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    return ship_package(spark)


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once a context: Python functions are pickled by name.

    The archive is built on the driver; Spark's file server hands it out.
    """
    context = spark.sparkContext
    package = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(package)
    if any(os.path.basename(f) == f"{name}.zip" for f in context._python_includes):
        return spark
    archive = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), f"{name}.zip")
    with zipfile.ZipFile(archive, "w") as bundle:
        for folder, _, files in os.walk(package):
            for file in sorted(files):
                if file.endswith(".py"):
                    path = os.path.join(folder, file)
                    bundle.write(path, os.path.join(name, os.path.relpath(path, package)))
    context.addPyFile(archive)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for cut lineage and stream checkpoints.

    A cluster names it in ``spark.checkpoint.dir``.  Only on a local master
    (tests, a laptop) does a temporary folder stand in where that is unset.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="skein-checkpoint-")
        spark.sparkContext.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize ``df`` on shared storage and forget how it was computed."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


#: Setting with the partition count for per-row Python work; 0 leaves an input as it is split.
PARSE_PARTITIONS = "spark.skein.parse.partitions"


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out by ``key`` for per-row Python work, into PARSE_PARTITIONS partitions.

    A file of one row group is one task however many cores wait and however
    it is split, so by default rows go to as many partitions as a shuffle has,
    at least one a core.  That exchanges the input once; a parse costs far more.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    asked = spark.conf.get(PARSE_PARTITIONS, None)
    if asked is None:
        asked = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(int(asked), key) if int(asked) else df
