"""Read marks, ignore words and pins."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import trim_space
from skein.operators.fanout import ignored_pairs
from skein.operators.subscriptions import is_unread, refresh_unread_counts, unread_counts


class Marked(NamedTuple):
    state: DataFrame
    subscriptions: DataFrame
    affected: DataFrame


def _finish(state: DataFrame, flagged: DataFrame, subscriptions: DataFrame, now: int) -> Marked:
    """``flagged`` is ``state`` plus a boolean ``_mark`` column."""
    hit = F.col("_mark") & F.col("read_at").isNull()
    affected = flagged.filter(hit)
    marked = flagged.withColumn("read_at", F.when(hit, F.lit(now)).otherwise(F.col("read_at"))).select(
        *state.columns
    )
    counts = affected.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    feeds = affected.select("feed_id").distinct()
    return Marked(marked, refresh_unread_counts(subscriptions, marked, feeds), counts)


def mark_ids_read(state: DataFrame, subscriptions: DataFrame, requests: DataFrame, now: int) -> Marked:
    """Mark (user_id, entry_id) pairs; ids without a state row are skipped."""
    asked = requests.select("user_id", "entry_id").distinct().withColumn("_m", F.lit(True))
    flagged = state.join(asked, ["user_id", "entry_id"], "left").withColumn("_mark", F.col("_m").isNotNull())
    return _finish(state, flagged, subscriptions, now)


def mark_where_read(state: DataFrame, subscriptions: DataFrame, where: Column, now: int) -> Marked:
    return _finish(state, state.withColumn("_mark", where), subscriptions, now)


def mark_all_read(state: DataFrame, subscriptions: DataFrame, user_id: int, now: int) -> Marked:
    return mark_where_read(state, subscriptions, F.col("user_id") == user_id, now)


def mark_feed_read(
    state: DataFrame, subscriptions: DataFrame, user_id: int, feed_id: int, before: int, now: int
) -> Marked:
    """Mark a feed read up to a publication time; ``before <= 0`` means all."""
    where = (F.col("user_id") == user_id) & (F.col("feed_id") == feed_id)
    if before > 0:
        where = where & (F.col("published_at") <= before)
    return mark_where_read(state, subscriptions, where, now)


def edit_ignore_words(
    ignore_words: DataFrame, added: DataFrame, removed: DataFrame, now: int
) -> DataFrame:
    """Words after trimmed, unique additions and removals (user_id, word)."""
    fresh = (
        added.select("user_id", trim_space(F.col("word")).alias("word"))
        .filter("word <> ''")
        .distinct()
        .join(ignore_words.select("user_id", "word"), ["user_id", "word"], "left_anti")
        .withColumn("created_at", F.lit(now).cast("bigint"))
    )
    kept = ignore_words.join(removed.select("user_id", "word"), ["user_id", "word"], "left_anti")
    return kept.select("user_id", "word", "created_at").unionByName(fresh)


def recompute_ignored(
    state: DataFrame,
    subscriptions: DataFrame,
    entries: DataFrame,
    ignore_words: DataFrame,
    users: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Set ``ignored`` both ways for the listed users and refresh their counters."""
    who = users.select("user_id").distinct()
    mine = state.join(who, "user_id", "left_semi")
    pairs = mine.select("user_id", "feed_id").distinct()
    hits = ignored_pairs(
        entries.join(pairs.select("feed_id").distinct(), "feed_id", "left_semi"),
        pairs,
        ignore_words.join(who, "user_id", "left_semi"),
    ).withColumn("_hit", F.lit(1))
    redone = (
        mine.join(hits, ["user_id", "entry_id"], "left")
        .withColumn("ignored", F.coalesce("_hit", F.lit(0)))
        .select(*state.columns)
    )
    new_state = state.join(who, "user_id", "left_anti").unionByName(redone)
    touched = unread_counts(subscriptions.join(who, "user_id", "left_semi"), redone)
    untouched = subscriptions.join(who, "user_id", "left_anti")
    return new_state, untouched.unionByName(touched.select(*subscriptions.columns))


def reignore_where(
    state: DataFrame, subscriptions: DataFrame, again: Column, hit: Column
) -> tuple[DataFrame, DataFrame]:
    """:func:`recompute_ignored` where state rows say themselves whether they are set anew and to what.

    ``again`` says it of a row of ``state``, by its user alone; counters of those users are refreshed.
    """
    new_state = state.withColumn("ignored", F.when(again, hit).otherwise(F.col("ignored")))
    counts = new_state.filter(again & is_unread()).groupBy("user_id", "feed_id").agg(F.count(F.lit(1)).alias("_n"))
    fresh = F.when(again, F.coalesce("_n", F.lit(0))).otherwise(F.col("unread_count"))
    return new_state, subscriptions.join(counts, ["user_id", "feed_id"], "left").withColumn("unread_count", fresh).drop("_n")


def add_pins(
    pins: DataFrame, requests: DataFrame, state: DataFrame, entries: DataFrame, now: int
) -> DataFrame:
    """Pin entries the user has a state row for, copying URL and title."""
    keys = ["user_id", "entry_id"]
    fresh = (
        requests.select(*keys)
        .distinct()
        .join(state.select(*keys), keys, "left_semi")
        .join(pins.select(*keys), keys, "left_anti")
        .join(entries.select(F.col("id").alias("entry_id"), "url", "title"), "entry_id")
        .withColumn("created_at", F.lit(now).cast("bigint"))
    )
    return pins.unionByName(fresh.select(*pins.columns))


def remove_pins(pins: DataFrame, requests: DataFrame) -> DataFrame:
    return pins.join(requests.select("user_id", "entry_id"), ["user_id", "entry_id"], "left_anti")


def newest_first(rows: DataFrame, user_id: int, tie: str) -> DataFrame:
    """A user's pins or ignore words, latest added first."""
    return rows.filter(F.col("user_id") == user_id).orderBy(F.desc("created_at"), F.asc(tie))
