"""Repeated page chrome: which subtrees to drop, and the learned counters.

``digests`` rows are (feed_id, page_ord, pos, end, sig, text_len, link_len):
candidate subtrees of each page, where ``pos``..``end`` is the node's interval
in document order and ``page_ord`` numbers a feed's pages from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.skew import sliced_running_count

MIN_TEXT = 32
MAX_DEPTH = 10
MAX_SIGNATURES = 2000
DECAY_PAGES = 64
MIN_PAGES = 2
PAGE_SLICE = 1024

MIN_FULLTEXT_CHARS = 200
MIN_STRIPPED_RATIO = 0.25


def is_chrome_shaped(text_len: Column, link_len: Column) -> Column:
    return (text_len == 0) | (link_len * 2 >= text_len)


def repeats_enough(seen_pages: Column, pages: Column) -> Column:
    return (seen_pages >= MIN_PAGES) & (seen_pages * 2 >= pages)


def number_pages(pages: DataFrame, feed: str, order: str) -> DataFrame:
    """Add ``page_ord``: how many earlier pages the feed has."""
    sliced = pages.withColumn("_slice", F.floor(F.col(order) / PAGE_SLICE))
    return sliced_running_count(sliced, [feed], "_slice", [F.asc(order)], "page_ord").drop("_slice")


def repeated_subtrees(digests: DataFrame) -> DataFrame:
    """Subtrees seen on enough earlier pages of the feed and mostly links.

    A signature counts once per page.  The running count is built from page
    slices, so a navigation bar on every page of one huge feed is still many
    small groups.
    """
    per_page = (
        digests.select("feed_id", "sig", "page_ord")
        .distinct()
        .withColumn("_slice", F.floor(F.col("page_ord") / PAGE_SLICE))
    )
    earlier = sliced_running_count(
        per_page, ["feed_id", "sig"], "_slice", [F.asc("page_ord")], "seen_pages"
    ).select("feed_id", "sig", "page_ord", "seen_pages")
    return digests.join(earlier, ["feed_id", "sig", "page_ord"]).filter(
        repeats_enough(F.col("seen_pages"), F.col("page_ord"))
        & is_chrome_shaped(F.col("text_len"), F.col("link_len"))
    )


def topmost(hits: DataFrame, page: list[str]) -> DataFrame:
    """Hits that lie inside no other hit of the same page."""
    # Intervals nest, so a hit is covered exactly when an earlier hit of the
    # page ends at or after it; a page's nodes are bounded by its size.
    before = Window.partitionBy(*page).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    cover = F.coalesce(F.max("end").over(before), F.lit(-1))
    return hits.withColumn("_cover", cover).filter(F.col("_cover") < F.col("pos")).drop("_cover")


def removed_blocks(digests: DataFrame) -> DataFrame:
    """The outermost repeated subtrees to cut from each page."""
    return topmost(repeated_subtrees(digests), ["feed_id", "page_ord"])


def cut_subtrees(nodes: DataFrame, removed: DataFrame, page: str) -> DataFrame:
    """DOM rows without the removed subtrees (page, pos, end)."""
    marks = removed.select(page, "pos", F.col("end").alias("_cut"))
    upto = Window.partitionBy(page).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    covered = nodes.join(marks, [page, "pos"], "left").withColumn(
        "_cover", F.coalesce(F.max("_cut").over(upto), F.lit(-1))
    )
    return covered.filter(F.col("_cover") < F.col("pos")).select(*nodes.columns)


def choose_extraction(
    stripped_len: Column, original_len: Column, stripped: Column, original: Column
) -> Column:
    """The stripped page's article unless cutting clearly went wrong.

    A null length means extraction failed on that side.
    """
    keep_original = (
        stripped_len.isNull()
        | (stripped_len < MIN_FULLTEXT_CHARS)
        | (stripped_len < F.coalesce(original_len, F.lit(0)) * MIN_STRIPPED_RATIO)
    )
    return F.when(keep_original, original).otherwise(stripped)


def observe_page(
    state: DataFrame, feeds: DataFrame, page_sigs: DataFrame, limit: int | None = MAX_SIGNATURES
) -> tuple[DataFrame, DataFrame]:
    """Fold one page per feed into the learned counters.

    ``state`` (feed_id, sig, count, last_seen), ``feeds`` (feed_id, pages),
    ``page_sigs`` (feed_id, sig) of the page just seen.  Counters halve at 64
    pages, zeros are dropped and a feed keeps its ``limit`` best signatures,
    which with one page bound its rows; None keeps them all.
    """
    touched = page_sigs.select("feed_id").distinct().withColumn("_hit", F.lit(1))
    pages = feeds.join(touched, "feed_id", "full").withColumn(
        "_pages", F.coalesce("pages", F.lit(0)) + F.coalesce("_hit", F.lit(0))
    )
    halve = (F.col("_hit") == 1) & (F.col("_pages") >= DECAY_PAGES)
    pages = pages.select(
        "feed_id",
        F.col("_hit").isNotNull().alias("_touched"),
        F.col("_pages").alias("_ordinal"),
        F.coalesce(halve, F.lit(False)).alias("_halve"),
    )
    new_feeds = pages.select(
        "feed_id",
        F.when(F.col("_halve"), F.floor(F.col("_ordinal") / 2)).otherwise(F.col("_ordinal")).alias("pages"),
    )
    merged = (
        state.join(page_sigs.select("feed_id", "sig").distinct().withColumn("_new", F.lit(1)),
                   ["feed_id", "sig"], "full")
        .join(pages, "feed_id")
        .withColumn("count", F.coalesce("count", F.lit(0)) + F.coalesce("_new", F.lit(0)))
        .withColumn("last_seen", F.when(F.col("_new") == 1, F.col("_ordinal")).otherwise(F.col("last_seen")))
        .withColumn("count", F.when(F.col("_halve"), F.floor(F.col("count") / 2)).otherwise(F.col("count")))
        .filter(F.col("count") > 0)
    )
    if limit is not None:
        best = Window.partitionBy("feed_id").orderBy(F.desc("count"), F.desc("last_seen"), F.desc("sig"))
        merged = merged.withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") <= limit)
    kept = merged.select(
        "feed_id", "sig", F.col("count").cast("bigint").alias("count"), F.col("last_seen").cast("bigint").alias("last_seen")
    )
    return kept, new_feeds
