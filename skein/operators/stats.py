"""Counters, gauges and quota checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.feeds import STOPPED_ERRORS
from skein.operators.subscriptions import is_unread
from skein.operators.timeline import TODAY_WINDOW

# Upper bounds in seconds of the fetch duration histogram.
DURATION_BUCKETS = (0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 60)
RECENT_ERRORS = 50


def today_unread(state: DataFrame, now: int) -> DataFrame:
    """Unread entries registered in the last 24 hours, per user."""
    return (
        state.filter(is_unread() & (F.col("created_at") >= now - TODAY_WINDOW))
        .groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("today_unread"))
    )


def queue_depth(feeds: DataFrame, now: int) -> DataFrame:
    """Due feeds, subscribed or not, as one row."""
    due = (F.col("next_fetch_at") <= now) & (F.col("error_count") < STOPPED_ERRORS)
    return feeds.agg(F.count_if(due).alias("queue_depth"))


def user_stats(subscriptions: DataFrame, feeds: DataFrame) -> DataFrame:
    """Feeds, erroring feeds and unread entries of every subscriber."""
    errors = feeds.select(F.col("id").alias("feed_id"), "error_count")
    return (
        subscriptions.join(errors, "feed_id", "left")
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("feeds_total"),
            F.count_if(F.col("error_count") > 0).alias("feeds_erroring"),
            F.coalesce(F.sum("unread_count"), F.lit(0)).alias("entries_unread"),
        )
    )


def erroring_views(views: DataFrame) -> DataFrame:
    return views.filter(F.col("error_count") > 0)


def fetch_counters(log: DataFrame) -> DataFrame:
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("fetches"))


def duration_histogram_columns(duration: Column) -> list[Column]:
    counts = [F.count_if(duration <= le).alias(f"le_{i}") for i, le in enumerate(DURATION_BUCKETS)]
    return [
        *counts,
        F.count(duration).alias("le_inf"),
        F.sum(duration).alias("duration_sum"),
        F.count(duration).alias("duration_count"),
    ]


def duration_histogram(log: DataFrame) -> DataFrame:
    """Cumulative buckets (le, observations), one pass over the log."""
    one = log.agg(*duration_histogram_columns(F.col("duration_s")))
    pairs = ", ".join([f"'{le:g}', le_{i}" for i, le in enumerate(DURATION_BUCKETS)] + ["'+Inf', le_inf"])
    return one.selectExpr(f"stack({len(DURATION_BUCKETS) + 1}, {pairs}) AS (le, observations)")


def duration_totals(log: DataFrame) -> DataFrame:
    return log.agg(
        F.sum("duration_s").alias("duration_sum"), F.count("duration_s").alias("duration_count")
    )


def crawl_summary(log: DataFrame) -> DataFrame:
    """Feeds, new entries and errors of one crawl (each row is one feed's fetch)."""
    return log.agg(
        F.count(F.lit(1)).alias("feeds"),
        F.coalesce(F.sum("new_entries"), F.lit(0)).alias("new_entries"),
        F.count_if(F.col("status").isin("error", "gone")).alias("errors"),
    )


def recent_errors(log: DataFrame, keep: int = RECENT_ERRORS) -> DataFrame:
    """The last ``keep`` internal failures (not what a feed's server answered), oldest first."""
    last = log.filter(F.col("status") == "internal").orderBy(F.desc("at_s"), F.desc("seq")).limit(keep)
    return last.orderBy("at_s", "seq")


def gauges(stats: DataFrame, depth: DataFrame, errors: DataFrame) -> DataFrame:
    """Long form (name, value) of one user's stats row plus the global gauges."""
    named = stats.selectExpr(
        "stack(3, 'feeds_total', feeds_total, 'feeds_erroring', feeds_erroring,"
        " 'entries_unread', entries_unread) AS (name, value)"
    )
    queue = depth.select(F.lit("queue_depth").alias("name"), F.col("queue_depth").alias("value"))
    recent = errors.agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("crawler_internal_errors_recent").alias("name"), "value"
    )
    return named.unionByName(queue).unionByName(recent)


def usage(resources: dict[str, DataFrame], limits: dict[str, int]) -> DataFrame:
    """Rows held per user and resource, with whether the quota is used up.

    A limit of 0 or less is no limit.
    """
    out = None
    for name, df in resources.items():
        limit = limits.get(name, 0)
        counted = df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select(
            "user_id",
            F.lit(name).alias("resource"),
            "n",
            (F.lit(limit > 0) & (F.col("n") >= limit)).alias("exceeded"),
        )
        out = counted if out is None else out.unionByName(counted)
    if out is None:
        raise ValueError("no resources given")
    return out
