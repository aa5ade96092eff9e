"""Repetition of element signatures on a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.markup import stable_signature

MIN_REPEATS = 2
SIBLING_ENOUGH = 3


def with_repetition(elements: DataFrame) -> DataFrame:
    """Each element with how often its signature recurs among siblings and on the page.

    ``elements``: (page_id, pos, parent, tag, classes).  ``score`` is the
    sibling count, or the page-wide count where siblings are few and the page
    has more; ``from_siblings`` says which.
    """
    signed = elements.withColumn("sig", stable_signature(F.col("tag"), F.col("classes")))
    siblings = signed.groupBy("page_id", "parent", "sig").agg(F.count(F.lit(1)).alias("n_siblings"))
    on_page = siblings.groupBy("page_id", "sig").agg(F.sum("n_siblings").alias("n_page"))
    counted = signed.join(siblings, ["page_id", "parent", "sig"]).join(on_page, ["page_id", "sig"])
    use_page = (F.col("n_siblings") < SIBLING_ENOUGH) & (F.col("n_page") > F.col("n_siblings"))
    return counted.withColumns(
        {
            "score": F.when(use_page, F.col("n_page")).otherwise(F.col("n_siblings")),
            "from_siblings": ~use_page,
        }
    )


def repeated_signatures(elements: DataFrame, top: int = 3) -> DataFrame:
    """The page's most repeated signatures, sibling repetition first."""
    best = (
        with_repetition(elements)
        .filter(F.col("score") >= MIN_REPEATS)
        .groupBy("page_id", "sig")
        .agg(F.max(F.struct("from_siblings", "score")).alias("_b"))
        .select("page_id", "sig", "_b.from_siblings", "_b.score")
    )
    order = Window.partitionBy("page_id").orderBy(F.desc("from_siblings"), F.desc("score"), F.asc("sig"))
    # One row per distinct signature of a page: bounded by the page size.
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
