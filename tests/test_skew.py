"""Sliced windows equal plain ones when one key holds most rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.skew import salted_join, sliced_last_value, sliced_rank, sliced_running_count, top_n_per_key


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    data = [(1 if rng.random() < 0.7 else rng.randrange(2, 9), i, rng.randrange(50), rng.random() < 0.2) for i in range(3000)]
    return spark.createDataFrame(data, "k int, id int, v int, hit boolean").cache()


def test_top_n(skewed):
    order = [F.desc("v"), F.desc("id")]
    got = top_n_per_key(skewed, ["k"], order, 37, F.col("id"), salts=7)
    want = skewed.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(*order))).filter("rn <= 37")
    assert sorted(got.collect()) == sorted(want.collect())


def test_rank(skewed):
    got = sliced_rank(skewed, ["k"], ["v"], [F.desc("v")], [F.asc("id")], "r")
    want = skewed.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("v"), F.asc("id"))))
    assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())


def test_rank_keeps_null_slices(spark):
    df = spark.createDataFrame([(1, None, 1), (1, 2, 2), (1, None, 3), (1, 1, 4)], "k int, s int, id int")
    got = sliced_rank(df, ["k"], ["s"], [F.asc_nulls_last("s")], [F.asc("id")], "r")
    assert {(r.id, r.r) for r in got.collect()} == {(4, 1), (2, 2), (1, 3), (3, 4)}


def test_running_count(skewed):
    sliced = skewed.withColumn("s", F.floor(F.col("id") / 100))
    got = sliced_running_count(sliced, ["k"], "s", [F.asc("id")], "n")
    want = sliced.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("id")) - 1)
    assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())


@pytest.mark.parametrize("forward", [True, False])
def test_last_value(skewed, forward):
    sliced = skewed.withColumn("s", F.floor(F.col("id") / 64))
    order = F.asc("id") if forward else F.desc("id")
    value = F.when(F.col("hit"), F.col("id"))
    got = sliced_last_value(sliced, ["k"], "s", [order], "id", value, "near", forward=forward)
    w = Window.partitionBy("k").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    want = sliced.withColumn("near", F.last(value, ignorenulls=True).over(w))
    assert sorted(got.select("id", "near").collect(), key=str) == sorted(want.select("id", "near").collect(), key=str)


def test_salted_join_equals_the_plain_join_and_splits_one_key(spark, rows):
    left = spark.range(5000).selectExpr("CASE WHEN id < 4900 THEN 1 ELSE id END AS k", "id AS a")
    right = spark.range(40).selectExpr("CASE WHEN id < 30 THEN 1 ELSE id + 4890 END AS k", "id AS b")
    odd = rows("k bigint, a bigint", [(None, -1)])
    want = left.join(right, "k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for counted in (True, False):
            got = salted_join(left.union(odd), right, ["k"], F.col("a"), F.col("b"), 10, counted)
            assert got.columns == ["k", "a", "b"]
            assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
            tasks = got.filter("k = 1").select(F.spark_partition_id()).distinct().count()
            assert tasks > 1  # one key, several tasks
    finally:
        for name in ("adaptive.coalescePartitions.enabled", "shuffle.partitions", "autoBroadcastJoinThreshold"):
            spark.conf.set(f"spark.sql.{name}", {"shuffle.partitions": "2"}.get(name, "true" if "adaptive" in name else "10MB"))
