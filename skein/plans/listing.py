"""Crawling listing pages: new links, their articles, the next state."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import listing
from skein.operators.robots import robots_allowed
from skein.plans.fulltext import listing_articles
from skein.session import cut_lineage
from skein.sources.listing import candidates, listing_matches

OK_STATUS = 200


class ListingRound(NamedTuple):
    entries: DataFrame
    state: listing.ListingState
    decisions: DataFrame


def listing_round(
    sources: DataFrame,
    pages: DataFrame,
    articles: DataFrame,
    seen: DataFrame,
    pending: DataFrame,
    rules: DataFrame,
    now: int,
) -> ListingRound:
    """One crawl of every listing.

    ``sources`` (source, url, *_selector, fulltext, max_items_per_crawl,
    has_state, state_valid), ``pages`` (source, html), ``articles``
    (article_id, url, http_status, html) the fetched article pages, ``rules``
    from ``robots_rules``.  A source with an unreadable state only seals what
    it sees; an article that failed is retried until the third failure.
    """
    polled = pages.join(sources, "source").withColumnRenamed("source", "page_id")
    matches = cut_lineage(listing_matches(polled))
    found = candidates(matches, polled, now).withColumnRenamed("page_id", "source")
    fresh = cut_lineage(listing.unseen(found, seen, "source"))
    settings = sources.select("source", "fulltext", "max_items_per_crawl", "has_state", "state_valid")
    totals = matches.groupBy(F.col("page_id").alias("source")).agg(F.max("matched").alias("matched"))
    n_new = fresh.groupBy("source").agg(F.count(F.lit(1)).alias("n_new"))
    decisions = (
        totals.join(settings, "source")
        .join(n_new, "source", "left")
        .fillna(0, ["n_new"])
        .select("source", listing.listing_decision().alias("decision"))
    )
    normal = decisions.filter(F.col("decision") == "new_items").select("source")
    tried = listing.cap_items(
        fresh.join(normal, "source", "left_semi").join(settings.drop("has_state", "state_valid"), "source"),
        "source",
        listing.effective_items(F.coalesce("max_items_per_crawl", F.lit(0))),
    )
    checked = robots_allowed(tried.select("url").distinct(), rules)
    got = articles.filter(F.col("http_status") == OK_STATUS).select("article_id", "url")
    outcome = cut_lineage(
        tried.join(checked, "url")
        .join(got, "url", "left")
        .join(pending.select("source", "url", F.col("n").alias("_tries")), ["source", "url"], "left")
        .withColumn("_wanted", F.coalesce("fulltext", F.lit(True)) & F.col("allowed"))
        .withColumn(
            "imported",
            ~F.col("_wanted") | F.col("article_id").isNotNull() | listing.gives_up(F.col("_tries")),
        )
    )
    imported = outcome.filter("imported")
    imported = imported.withColumn("_page", F.when(F.col("_wanted"), F.col("article_id")))
    # An article that several listings link is extracted once; what a listing says itself comes first.
    wanted = imported.filter(F.col("_page").isNotNull()).groupBy("_page").agg(
        F.min("source").alias("feed_id"), F.min("url").alias("_url")
    )
    nothing = F.lit(None).cast("string")
    texts = listing_articles(
        wanted.select(
            F.col("_page").alias("page_id"),
            F.col("_url").alias("url"),
            nothing.alias("title"),
            nothing.alias("summary"),
            F.lit(None).cast("bigint").alias("published_at"),
        ),
        articles.join(wanted.select(F.col("_page").alias("article_id"), "feed_id"), "article_id").select(
            F.col("article_id").alias("page_id"), "feed_id", "url", "html"
        ),
        now,
    ).select(
        F.col("page_id").alias("_page"),
        F.col("title").alias("_title"),
        F.col("body").alias("_body"),
        F.col("published_at").alias("_at"),
    )
    entries = imported.join(texts, "_page", "left").select(
        "source",
        "pos",
        F.col("url").alias("guid"),
        "url",
        F.when(F.col("_title").isNull(), F.col("title"))
        .otherwise(F.coalesce(F.nullif("title", F.lit("")), "_title"))
        .alias("title"),
        F.coalesce("_body", "summary").alias("body"),
        F.coalesce("published_at", "_at", F.lit(now)).cast("bigint").alias("published_at"),
    )
    imported = imported.drop("_page")

    resync = decisions.filter(F.col("decision") == "resync").select("source")
    sealed = found.join(resync, "source", "left_semi")
    first_time = sources.filter(~F.col("has_state")).select("source")
    # Sources without new candidates write no state, so only the rest are folded.
    state = listing.commit_state(
        seen.join(resync, "source", "left_anti"),
        pending.join(resync, "source", "left_anti"),
        fresh.join(normal, "source", "left_semi").select("source", "url", "pos"),
        imported.select("source", "url", "pos"),
        outcome.filter(~F.col("imported")).select("source", "url"),
        first_time,
    )
    resynced = listing.ListingState(
        state.seen.unionByName(sealed.select("source", "url", F.col("pos").cast("bigint").alias("seq"))),
        state.pending,
    )
    return ListingRound(entries, resynced, decisions)

