"""Connected components of a link table by minimum labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import stored


def _step(both: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, old, label) after one round: the least label around a node, then that label's label."""
    near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
    least = labels.join(near, F.col("node") == F.col("a")).select(
        "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
    )
    jump = labels.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
    return least.join(jump, "label", "left").select(
        "node", "old", F.least("label", F.coalesce("beyond", "label")).alias("label")
    )


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _first_labels(both: DataFrame) -> DataFrame:
    return both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label"))


def connected(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (columns a, b); the label is the smallest node.

    Each round takes the smallest label among a node and its neighbours, then
    the label of that label, so a chain of n links ends in about log n rounds.
    Aggregates combine on the map side, so a node with very many links sends
    one row a task.
    """
    both = stored(_both_ways(links), "links")
    labels = stored(_first_labels(both), "labels")
    while True:
        after = stored(_step(both, labels), "labels")
        labels = after.select("node", "label")
        if after.filter(F.col("label") != F.col("old")).isEmpty():
            return labels
