"""Article bodies with a feed's repeated chrome removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import truncate_utf8
from skein.functions.urls import path_tail
from skein.operators import boilerplate
from skein.operators.pagedom import article_bodies, page_titles, published_dates
from skein.session import cut_lineage
from skein.sources.dom import TEXT, dom_rows
from skein.sources.sanitize import sanitize_html


def candidate_digests(signed_nodes: DataFrame) -> DataFrame:
    """Subtrees worth counting, from signed DOM rows (html is depth 0 there)."""
    return signed_nodes.filter(
        F.col("in_body")
        & ~F.col("tag").isin(TEXT, "body")
        & (F.col("depth") + 1 <= boilerplate.MAX_DEPTH)
        & (F.col("text_len") >= boilerplate.MIN_TEXT)
    ).select("page_id", "pos", "end", "sig", "text_len", "link_len")


def removed_subtrees(pages: DataFrame, signed_nodes: DataFrame) -> DataFrame:
    """Chrome to cut from (page_id, feed_id) pages, each feed ordered by page_id."""
    numbered = boilerplate.number_pages(pages.select("page_id", "feed_id"), "feed_id", "page_id")
    return boilerplate.removed_blocks(candidate_digests(signed_nodes).join(numbered, "page_id"))


def article_texts(pages: DataFrame) -> DataFrame:
    """(page_id, content, text_len, stripped): the better of stripped and original.

    Pages without a removable subtree are extracted once, unchanged.
    """
    nodes = cut_lineage(dom_rows(pages, signed=True))
    removed = cut_lineage(removed_subtrees(pages, nodes).select("page_id", "pos", "end"))
    original = article_bodies(nodes, pages)
    touched = nodes.join(removed.select("page_id").distinct(), "page_id", "left_semi")
    cut = article_bodies(boilerplate.cut_subtrees(touched, removed, "page_id"), pages)
    side = cut.select("page_id", F.col("content").alias("_cut"), F.col("text_len").alias("_cut_len"))
    both = original.join(side, "page_id", "full")
    pick = boilerplate.choose_extraction(
        F.col("_cut_len"),
        F.col("text_len"),
        F.struct(F.col("_cut").alias("content"), F.col("_cut_len").alias("text_len"), F.lit(True).alias("stripped")),
        F.struct("content", "text_len", F.lit(False).alias("stripped")),
    )
    return both.select("page_id", pick.alias("_p")).select("page_id", "_p.*")


def accept_body(content: Column, text_len: Column, summary: Column) -> Column:
    """The article body when it is long enough, else the feed's own summary."""
    long_enough = F.coalesce(text_len >= boilerplate.MIN_FULLTEXT_CHARS, F.lit(False))
    return F.when(long_enough, truncate_utf8(sanitize_html(content))).otherwise(summary)


def listing_articles(items: DataFrame, pages: DataFrame, now: int) -> DataFrame:
    """Fill body, title and date of listing items from their article pages.

    ``items`` (page_id, url, title, summary, published_at), ``pages``
    (page_id, feed_id, url, html).  Title: listing, article <title>, URL tail.
    """
    nodes = cut_lineage(dom_rows(pages))
    articles = article_texts(pages)
    out = (
        items.join(articles, "page_id", "left")
        .join(page_titles(nodes), "page_id", "left")
        .join(published_dates(nodes, now).withColumnRenamed("published_at", "_page_date"), "page_id", "left")
    )
    blank = F.lit("")
    return out.select(
        "page_id",
        "url",
        F.coalesce(
            F.nullif("title", blank), F.nullif("page_title", blank), path_tail(F.col("url"))
        ).alias("title"),
        accept_body(F.col("content"), F.col("text_len"), F.col("summary")).alias("body"),
        F.coalesce("published_at", "_page_date", F.lit(now)).cast("bigint").alias("published_at"),
    )
