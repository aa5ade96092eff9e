"""Subscription views, unread counters, sidebar order and patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.urls import feed_kind, feed_target
from skein.skew import sliced_last_value, sliced_rank

ERRORING_THRESHOLD = 3
NAV_SLICE = 1024


def is_unread() -> Column:
    return F.col("read_at").isNull() & (F.col("ignored") == 0)


def unread_counts(subscriptions: DataFrame, state: DataFrame) -> DataFrame:
    """``subscriptions`` with ``unread_count`` recomputed; zero is kept."""
    counts = (
        state.filter(is_unread()).groupBy("user_id", "feed_id").agg(F.count(F.lit(1)).alias("_unread"))
    )
    return (
        subscriptions.drop("unread_count")
        .join(counts, ["user_id", "feed_id"], "left")
        .withColumn("unread_count", F.coalesce("_unread", F.lit(0)))
        .drop("_unread")
    )


def refresh_unread_counts(subscriptions: DataFrame, state: DataFrame, feeds: DataFrame) -> DataFrame:
    """Recompute only the counters of the feeds listed in ``feeds`` (feed_id)."""
    touched = feeds.select("feed_id").distinct().withColumn("_touched", F.lit(True))
    counts = (
        state.join(touched.select("feed_id"), "feed_id", "left_semi")
        .filter(is_unread())
        .groupBy("user_id", "feed_id")
        .agg(F.count(F.lit(1)).alias("_unread"))
    )
    fresh = F.when(F.col("_touched"), F.coalesce("_unread", F.lit(0))).otherwise(F.col("unread_count"))
    return (
        subscriptions.join(touched, "feed_id", "left")
        .join(counts, ["user_id", "feed_id"], "left")
        .withColumn("unread_count", fresh)
        .select(*subscriptions.columns)
    )


def subscription_views(
    subscriptions: DataFrame, feeds: DataFrame, entries: DataFrame, fulltext: DataFrame
) -> DataFrame:
    """Subscriptions with display and crawl metadata of their feed."""
    newest = entries.groupBy("feed_id").agg(F.max("published_at").alias("last_entry_at"))
    enabled = fulltext.select("feed_id", F.lit(True).alias("_ft"))
    meta = feeds.select(
        F.col("id").alias("feed_id"),
        feed_target(F.col("feed_url")).alias("feed_url"),
        feed_kind(F.col("feed_url")).alias("kind"),
        F.coalesce("site_url", F.lit("")).alias("site_url"),
        F.col("title").alias("_feed_title"),
        "last_status", "error_count", "last_error", "last_fetched_at", "next_fetch_at",
    )
    per_feed = meta.join(newest, "feed_id", "left").join(enabled, "feed_id", "left")
    return (
        subscriptions.join(per_feed, "feed_id")
        .withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.col("_feed_title")))
        .withColumn("fulltext", F.coalesce("_ft", F.lit(False)))
        .drop("_feed_title", "_ft")
    )


def with_unread_only(views: DataFrame) -> DataFrame:
    return views.filter(F.col("unread_count") > 0)


def erroring(error_count: Column) -> Column:
    return error_count >= ERRORING_THRESHOLD


def filter_views(
    views: DataFrame,
    kind: str = "all",
    only_errors: bool = False,
    min_error_count: int | None = None,
    url_needle: str = "",
    error_needle: str = "",
    query: str = "",
) -> DataFrame:
    """Feed manager list, ordered by title (or URL when untitled)."""

    def holds(column: str, needle: str) -> Column:
        return F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(needle.strip().lower()))

    out = views
    if kind != "all":
        out = out.filter(F.col("kind") == kind)
    if only_errors:
        out = out.filter(erroring(F.col("error_count")))
    if min_error_count is not None:
        out = out.filter(F.col("error_count") >= min_error_count)
    if url_needle.strip():
        out = out.filter(holds("feed_url", url_needle))
    if error_needle.strip():
        out = out.filter(holds("last_error", error_needle))
    if query.strip():
        out = out.filter(holds("title", query) | holds("feed_url", query) | holds("site_url", query))
    return out.orderBy(F.coalesce(F.nullif("title", F.lit("")), F.col("feed_url")), "feed_id")


def group_counters(views: DataFrame) -> DataFrame:
    """Unread sum, feeds and erroring feeds per user, folder, rating and kind.

    ``scope`` says which grouping a row belongs to and ``bucket`` its value;
    the unfiled folder has bucket '0'.
    """
    tagged = views.select(
        "user_id", "unread_count", "error_count",
        F.coalesce("folder_id", F.lit(0)).cast("string").alias("folder"),
        F.col("rating").cast("string").alias("rating"),
        "kind",
    )
    user, folder, rating, kind = (F.col(c) for c in ("user_id", "folder", "rating", "kind"))
    # Grouping ids in bit order folder, rating, kind; a set bit means "not grouped".
    gid = F.grouping_id()
    return tagged.groupingSets(
        [[user], [user, folder], [user, rating], [user, kind]], user, folder, rating, kind
    ).agg(
        F.when(gid == 3, "folder").when(gid == 5, "rating").when(gid == 6, "kind").otherwise("all").alias("scope"),
        F.sum("unread_count").alias("unread"),
        F.count(F.lit(1)).alias("feeds"),
        F.count_if(erroring(F.col("error_count"))).alias("erroring"),
    ).select(
        "user_id", "scope", F.coalesce("folder", "rating", "kind", F.lit("")).alias("bucket"),
        "unread", "feeds", "erroring",
    )


def _ranked_sidebar(views: DataFrame, group_cols: list[str], group_order: list[Column]) -> DataFrame:
    keyed = (
        views.withColumn("_read", F.when(F.col("unread_count") > 0, 0).otherwise(1))
        .withColumn("_last", F.coalesce("last_entry_at", F.lit(0)))
        .withColumn("_day", F.floor(F.col("_last") / 86400))
        .withColumn("_name", F.coalesce(F.nullif("title", F.lit("")), F.col("feed_url")))
    )
    return sliced_rank(
        keyed,
        ["user_id"],
        [*group_cols, "_read", "_day"],
        [*group_order, F.asc("_read"), F.desc("_day")],
        [F.desc("_last"), F.asc("_name"), F.asc("feed_id")],
        "position",
    ).drop("_read", "_last", "_day", "_name")


def sidebar_by_folder(views: DataFrame, folders: DataFrame) -> DataFrame:
    """Display position by folder (sort order, name), the unfiled bucket last.

    Inside a group: unread first, newest entry first, then title.
    """
    meta = folders.select(
        "user_id",
        F.col("id").alias("folder_id"),
        F.col("sort_order").alias("_fsort"),
        F.col("name").alias("group_name"),
    )
    filed = views.filter(F.col("folder_id").isNotNull()).join(meta, ["user_id", "folder_id"])
    unfiled = (
        views.filter(F.col("folder_id").isNull())
        .withColumn("_fsort", F.lit(None).cast("bigint"))
        .withColumn("group_name", F.lit("(未分類)"))
    )
    both = filed.unionByName(unfiled)
    return _ranked_sidebar(
        both, ["_fsort", "group_name"], [F.asc_nulls_last("_fsort"), F.asc("group_name")]
    ).drop("_fsort")


def sidebar_by_rating(views: DataFrame) -> DataFrame:
    """Display position by rating 5 to 0, same order inside a group."""
    return _ranked_sidebar(views, ["rating"], [F.desc("rating")])


def adjacent_unread(sidebar: DataFrame) -> DataFrame:
    """For every displayed feed its previous and next feed with unread entries."""
    sliced = sidebar.withColumn("_slice", F.floor(F.col("position") / NAV_SLICE))
    unread_feed = F.when(F.col("unread_count") > 0, F.col("feed_id"))
    after = sliced_last_value(
        sliced, ["user_id"], "_slice", [F.asc("position")], "position", unread_feed, "prev_unread"
    )
    return sliced_last_value(
        after, ["user_id"], "_slice", [F.desc("position")], "position", unread_feed, "next_unread", forward=False
    ).drop("_slice")


def upsert_subscriptions(subscriptions: DataFrame, requests: DataFrame, now: int) -> DataFrame:
    """Create subscriptions or replace folder and title of existing ones.

    ``requests``: (user_id, feed_id, folder_id, title), one row per pair.
    """
    r = requests.select(
        "user_id", "feed_id", F.col("folder_id").alias("_folder"), F.col("title").alias("_title"),
        F.lit(True).alias("_asked"),
    )
    joined = subscriptions.withColumn("_old", F.lit(True)).join(r, ["user_id", "feed_id"], "full")
    asked, old = F.col("_asked").isNotNull(), F.col("_old").isNotNull()
    return joined.select(
        "user_id",
        "feed_id",
        F.when(asked, F.col("_folder")).otherwise(F.col("folder_id")).alias("folder_id"),
        F.when(asked, F.col("_title")).otherwise(F.col("title")).alias("title"),
        F.when(old, F.col("rating")).otherwise(0).alias("rating"),
        F.when(old, F.col("unread_count")).otherwise(0).alias("unread_count"),
        F.when(old, F.col("sort_order")).otherwise(0).alias("sort_order"),
        F.when(old, F.col("created_at")).otherwise(now).alias("created_at"),
    )


def unsubscribe(
    subscriptions: DataFrame, state: DataFrame, requests: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Drop subscriptions and those users' state rows; pins and entries stay."""
    gone = requests.select("user_id", "feed_id").join(
        subscriptions.select("user_id", "feed_id"), ["user_id", "feed_id"], "left_semi"
    )
    keys = ["user_id", "feed_id"]
    return subscriptions.join(gone, keys, "left_anti"), state.join(gone, keys, "left_anti")


def patch_subscriptions(subscriptions: DataFrame, patches: DataFrame) -> DataFrame:
    """Apply partial updates: null leaves a field, folder 0 clears the folder.

    ``patches``: (user_id, feed_id, title, rating, rating_delta, folder_id).
    A rating delta is clamped to 0..5.
    """
    p = patches.select("user_id", "feed_id", *[
        F.col(c).alias(f"_{c}") for c in ("title", "rating", "rating_delta", "folder_id")
    ])
    # least and greatest skip nulls, so the clamp needs its own null test.
    clamped = F.least(F.lit(5), F.greatest(F.lit(0), F.col("rating") + F.col("_rating_delta")))
    shifted = F.when(F.col("_rating_delta").isNotNull(), clamped)
    folder = F.when(F.col("_folder_id") == 0, F.lit(None)).otherwise(F.coalesce("_folder_id", "folder_id"))
    return (
        subscriptions.join(p, ["user_id", "feed_id"], "left")
        .withColumn("title", F.coalesce("_title", "title"))
        .withColumn("rating", F.coalesce(F.col("_rating"), shifted, F.col("rating")))
        .withColumn("folder_id", folder)
        .select(*subscriptions.columns)
    )


def get_or_create_folders(folders: DataFrame, wanted: DataFrame) -> DataFrame:
    """Folders plus the missing (user_id, name) pairs with derived ids."""
    fresh = (
        wanted.select("user_id", "name")
        .distinct()
        .join(folders.select("user_id", "name"), ["user_id", "name"], "left_anti")
        .select(
            "user_id",
            F.xxhash64("user_id", "name").alias("id"),
            "name",
            F.lit(0).cast("bigint").alias("sort_order"),
        )
    )
    return folders.select("user_id", "id", "name", "sort_order").unionByName(fresh)


def subscribed_only(rows: DataFrame, subscriptions: DataFrame, user_id: int) -> DataFrame:
    """Rows about feeds the user subscribes to."""
    mine = subscriptions.filter(F.col("user_id") == user_id).select("feed_id")
    return rows.join(mine, "feed_id", "left_semi")
