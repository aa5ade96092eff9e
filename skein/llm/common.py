"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.session import shared_dir

#: Arrow batches close at this size, so a batch is this or one long row.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skein-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(
    df: DataFrame,
    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """``mapInArrow`` over batches bounded by bytes, not by rows alone."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    return df.mapInArrow(run, schema)


def prefix_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], amount: str, out: str, rows_per_slice: int = 50_000
) -> DataFrame:
    """``out``: the sum of ``amount`` over earlier rows of the same ``keys``, in an order by slice.

    The order is by a hash slice, then ``order`` (whose columns must be unique
    within a key).  Slices are summed map-side first, so no task sees more
    than one slice's rows, however hot a key is.
    """
    total = df.count()
    slices = max(1, -(-total // rows_per_slice))
    cut = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    sums = cut.groupBy(*keys, "_slice").agg(F.sum(amount).alias("_sum"))
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_slice")
    offsets = sums.select(
        *keys,
        "_slice",
        F.coalesce(F.sum("_sum").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
    )
    inner = (
        Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        cut.join(offsets, [*keys, "_slice"])
        .withColumn(out, F.col("_base") + F.coalesce(F.sum(amount).over(inner), F.lit(0)))
        .drop("_slice", "_base")
    )


def spans_digest(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
