"""One ingest round: responses to items to tables to the next fetch times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.feeds import apply_updates, fold_outcomes, settle_outcomes
from skein.operators.ingest import KEY, Ingested, upsert_entries
from skein.plans.incremental import Applied, apply_items, first_sightings
from skein.session import cut_lineage
from skein.sources.buckets import BucketedTables
from skein.sources.feeds import feed_headers, feed_items, normalize_items

OK_STATUS = 200
NOT_MODIFIED = 304
GONE = 410


def fetch_outcomes(fetched: DataFrame, items: DataFrame, new_entries: DataFrame) -> DataFrame:
    """Outcome rows of (feed_id, feed_url, http_status, body, ...) responses."""
    heads = feed_headers(items).withColumnRenamed("error", "_parse_error")
    counts = new_entries.groupBy("feed_id").agg(F.count(F.lit(1)).alias("new_entries"))
    code = F.col("http_status")
    status = (
        F.when(code == NOT_MODIFIED, "not_modified")
        .when(code == GONE, "gone")
        .when((code != OK_STATUS) | F.col("_parse_error").isNotNull(), "error")
        .otherwise("ok")
    )
    error = (
        F.when(code == GONE, F.lit("410 gone"))
        .when(~code.isin(OK_STATUS, NOT_MODIFIED), F.concat(F.lit("unexpected status "), code.cast("string")))
        .otherwise(F.col("_parse_error"))
    )
    body_hash = F.when((code == OK_STATUS) & F.col("_parse_error").isNull(), F.sha2("body", 256))
    return (
        fetched.join(heads, "feed_id", "left")
        .join(counts, "feed_id", "left")
        .select(
            "feed_id",
            status.alias("status"),
            F.coalesce("new_entries", F.lit(0)).alias("new_entries"),
            F.coalesce("retry_after", F.lit(0)).alias("retry_after"),
            error.alias("error"),
            F.coalesce("title", F.lit("")).alias("title"),
            F.coalesce("site_url", F.lit("")).alias("site_url"),
            "new_feed_url",
            F.nullif("etag", F.lit("")).alias("etag"),
            F.nullif("last_modified", F.lit("")).alias("last_modified"),
            body_hash.alias("body_hash"),
            "http_status",
        )
    )


def ingest_round(tables: dict[str, DataFrame], fetched: DataFrame, now: int) -> dict[str, DataFrame]:
    """Apply one batch of responses to feeds, entries, state and subscriptions.

    ``fetched``: (feed_id, feed_url, http_status, body, retry_after,
    new_feed_url, etag, last_modified), one row per feed.
    """
    good = fetched.filter(F.col("http_status") == OK_STATUS)
    # Parsing is the expensive step and feeds four results below.
    items = cut_lineage(feed_items(good))
    batch = cut_lineage(normalize_items(items, now))
    done: Ingested = upsert_entries(
        tables["entries"], tables["state"], tables["subscriptions"], tables["ignore_words"], batch, now
    )
    outcomes = fetch_outcomes(fetched, items, done.new_entries)
    feeds = apply_updates(tables["feeds"], settle_outcomes(outcomes, tables["feeds"], now), now)
    return {
        **tables, "feeds": feeds, "entries": done.entries, "state": done.state,
        "subscriptions": done.subscriptions,
    }


def ingest_responses(
    tables: BucketedTables, fetched: DataFrame, batch_id: int | None = None, again: bool = False
) -> Applied:
    """Apply any number of responses a feed to bucketed tables, with one write a table.

    ``fetched`` as for ``ingest_round`` with ``at_s``, the time of each
    response.  A feed's responses count in order of at_s (equal times in the
    order of the other columns).  Feed rows remember ``batch_id``, so with
    ``again`` an outcome that was stored already is not counted twice.
    """
    others = [c for c in fetched.columns if c not in ("feed_id", "at_s")]
    order = Window.partitionBy("feed_id").orderBy("at_s", F.xxhash64(*others))
    responses = cut_lineage(
        fetched.withColumn("turn", F.row_number().over(order)).withColumn("response", F.monotonically_increasing_id())
    )
    told = responses.select(F.col("response").alias("feed_id"), F.col("feed_id").alias("_feed"), "turn", "at_s")
    good = responses.filter(F.col("http_status") == OK_STATUS)
    # A response stands in for its feed while items are parsed and normalized.
    parsed = cut_lineage(feed_items(good.withColumn("feed_id", F.col("response"))))
    timed = parsed.join(told.select("feed_id", "at_s"), "feed_id")
    items = normalize_items(timed, F.col("at_s")).join(told, "feed_id")
    batch = cut_lineage(items.withColumn("feed_id", F.col("_feed")).drop("_feed"))

    heard = responses.withColumnRenamed("feed_id", "_feed").withColumnRenamed("response", "feed_id")
    known = tables.read("entries", tables.buckets_of(batch, "feed_id")).select(*KEY)
    fresh = first_sightings(batch).join(known, KEY, "left_anti").select("feed_id", "turn")
    new = fresh.join(told.select(F.col("feed_id").alias("_r"), F.col("_feed").alias("feed_id"), "turn"), ["feed_id", "turn"])
    outcomes = (
        fetch_outcomes(heard, parsed, new.select(F.col("_r").alias("feed_id")))
        .join(told, "feed_id")
        .withColumn("feed_id", F.col("_feed"))
    )
    feeds = tables.read("feeds")
    if again and batch_id is not None:
        applied = feeds.filter(F.col("applied_batch") >= batch_id).select(F.col("id").alias("feed_id"))
        outcomes = outcomes.join(applied, "feed_id", "left_anti")
    folded = fold_outcomes(feeds, outcomes).withColumn("applied_batch", F.lit(batch_id).cast("bigint"))
    return apply_items(tables, batch, folded, again)
