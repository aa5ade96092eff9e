"""Keyset-paginated timelines and search.

State rows carry feed_id, published_at and created_at, so a timeline page is
chosen from narrow rows alone and only its (at most ``limit``) winners are
joined to the wide entry text.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.items import format_cursor
from skein.functions.text import like_contains, literal_contains
from skein.skew import top_n_per_key

DEFAULT_LIMIT = 100
MAX_LIMIT = 500
TODAY_WINDOW = 24 * 3600

ENTRY_COLUMNS = [
    "id", "feed_id", "guid", "url", "title", "author", "body",
    "published_at", "updated_at", "fetched_at", "read_at", "pinned",
]


class Cursor(NamedTuple):
    published_at: int
    id: int


def effective_limit(limit: int | None) -> int:
    """Requested page size, or the default when it is out of range."""
    return limit if limit is not None and 0 < limit <= MAX_LIMIT else DEFAULT_LIMIT


def before_cursor(cursor: Cursor | None, entry: Column) -> Column:
    """Keyset predicate plus the implied bound that parquet can prune with."""
    if cursor is None:
        return F.lit(True)
    pub = F.col("published_at")
    return (pub <= cursor.published_at) & (
        (pub < cursor.published_at) | ((pub == cursor.published_at) & (entry < cursor.id))
    )


def _newest(df: DataFrame, entry: str, limit: int) -> DataFrame:
    return df.orderBy(F.desc("published_at"), F.desc(entry)).limit(limit)


def visible_state(state: DataFrame, user_id: int, unread_only: bool, cursor: Cursor | None) -> DataFrame:
    rows = state.filter((F.col("user_id") == user_id) & (F.col("ignored") == 0))
    if unread_only:
        rows = rows.filter(F.col("read_at").isNull())
    return rows.filter(before_cursor(cursor, F.col("entry_id")))


def with_pins(df: DataFrame, pins: DataFrame, user_id: int) -> DataFrame:
    mine = pins.filter(F.col("user_id") == user_id).select(F.col("entry_id").alias("_pin"))
    return df.join(mine, df["id"] == mine["_pin"], "left").withColumn("pinned", F.col("_pin").isNotNull())


def _page(
    chosen: DataFrame, entries: DataFrame, pins: DataFrame, user_id: int, limit: int
) -> DataFrame:
    winners = _newest(chosen, "entry_id", limit).select("entry_id", "read_at")
    rows = entries.join(winners, entries["id"] == winners["entry_id"])
    return _newest(with_pins(rows, pins, user_id).select(*ENTRY_COLUMNS), "id", limit)


def feed_timeline(
    entries: DataFrame,
    state: DataFrame,
    pins: DataFrame,
    user_id: int,
    feed_id: int,
    unread_only: bool = False,
    limit: int = DEFAULT_LIMIT,
    cursor: Cursor | None = None,
) -> DataFrame:
    """One feed's entries for a user, newest first."""
    chosen = visible_state(state, user_id, unread_only, cursor).filter(F.col("feed_id") == feed_id)
    return _page(chosen, entries.filter(F.col("feed_id") == feed_id), pins, user_id, limit)


def group_timeline(
    entries: DataFrame,
    state: DataFrame,
    subscriptions: DataFrame,
    pins: DataFrame,
    user_id: int,
    where: Column,
    unread_only: bool,
    limit: int = DEFAULT_LIMIT,
    cursor: Cursor | None = None,
) -> DataFrame:
    """Merged timeline of the user's subscriptions that satisfy ``where``."""
    subs = subscriptions.filter((F.col("user_id") == user_id) & where).select("feed_id")
    chosen = visible_state(state, user_id, unread_only, cursor).join(subs, "feed_id", "left_semi")
    return _page(chosen, entries, pins, user_id, limit)


def folder_timeline(entries, state, subscriptions, pins, user_id, folder_id, unread_only=False, **page):
    """A folder's timeline; ``None`` is the unfiled bucket."""
    where = F.col("folder_id").eqNullSafe(F.lit(folder_id).cast("bigint"))
    return group_timeline(entries, state, subscriptions, pins, user_id, where, unread_only, **page)


def rating_timeline(entries, state, subscriptions, pins, user_id, rating, unread_only=False, **page):
    where = F.col("rating") == rating
    return group_timeline(entries, state, subscriptions, pins, user_id, where, unread_only, **page)


def today_timeline(entries, state, subscriptions, pins, user_id, now, **page):
    """Unread entries first registered in the last 24 hours."""
    recent = state.filter(F.col("created_at") >= now - TODAY_WINDOW)
    return group_timeline(entries, recent, subscriptions, pins, user_id, F.lit(True), True, **page)


def page_cuts(entries: DataFrame, state: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """(user_id, _from): no unread entry published before ``_from`` is on the user's first page.

    Times are cut at quantiles of ``entries`` that get finer towards the newest;
    a user's unread rows are counted between them (combined on the map side),
    and ``_from`` is the latest cut with ``limit`` rows at or after it.  It is
    null where a user has too few, and the page then needs every row.
    """
    shares = F.array(*[F.lit(1 - 2 ** (-i / 2)) for i in range(40)])
    found = entries.agg(F.percentile_approx("published_at", shares, F.lit(100_000)).alias("_q")).first()["_q"]
    published = F.col("published_at")
    floor = F.lit(None).cast("bigint")
    for edge in sorted(set(found or [])):
        floor = F.when(published >= edge, F.lit(edge).cast("bigint")).otherwise(floor)
    unread = state.filter(F.col("read_at").isNull() & (F.col("ignored") == 0))
    counts = unread.groupBy("user_id", floor.alias("_floor")).agg(F.count(F.lit(1)).alias("_n"))
    # At most one row a cut and user.
    newer = Window.partitionBy("user_id").orderBy(F.desc_nulls_last("_floor"))
    reached = F.sum("_n").over(newer) >= limit
    return counts.withColumn("_cut", F.when(reached, F.col("_floor"))).groupBy("user_id").agg(F.max("_cut").alias("_from"))


def first_pages(
    entries: DataFrame, state: DataFrame, pins: DataFrame, limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """The newest unread page of every user at once, ranked by ``rn``.

    The batch form of an unread timeline: pages are cut from narrow state rows
    (in salted slices, so a user with most of the rows is still many groups)
    before any entry text is read.
    """
    unread = state.filter(F.col("read_at").isNull() & (F.col("ignored") == 0)).select(
        "user_id", "entry_id", "feed_id", "published_at"
    )
    pages = top_n_per_key(
        unread, ["user_id"], [F.desc("published_at"), F.desc("entry_id")], limit, F.col("entry_id"), salts=16
    )
    text = entries.select(F.col("id").alias("entry_id"), "url", "title")
    pinned = pins.select("user_id", "entry_id", F.lit(True).alias("_pin"))
    return (
        pages.join(pinned, ["user_id", "entry_id"], "left")
        .join(text, "entry_id")
        .select(
            "user_id", "rn", "entry_id", "feed_id", "url", "title", "published_at",
            F.col("_pin").isNotNull().alias("pinned"),
        )
    )


def today_by_rating(timeline: DataFrame, subscriptions: DataFrame, user_id: int) -> DataFrame:
    """The page re-bucketed by rating 5 to 0, newest first inside; adds ``position``."""
    ratings = subscriptions.filter(F.col("user_id") == user_id).select("feed_id", "rating")
    order = Window.orderBy(F.desc("rating"), F.desc("published_at"), F.desc("id"))
    rated = timeline.join(ratings, "feed_id", "left").withColumn("rating", F.coalesce("rating", F.lit(0)))
    # The input is one page (at most MAX_LIMIT rows), so one window task is right.
    return rated.withColumn("position", F.row_number().over(order))


def matches_query(query: str) -> Column:
    """Literal substring from 3 characters on, SQLite LIKE below that."""
    test = literal_contains if len(query) >= 3 else like_contains
    needle = F.lit(query)
    return test(F.col("title"), needle) | test(F.col("body"), needle)


def search(
    entries: DataFrame,
    state: DataFrame,
    subscriptions: DataFrame,
    pins: DataFrame,
    user_id: int,
    query: str,
    limit: int | None = None,
    cursor: Cursor | None = None,
) -> DataFrame:
    """Entries of the user's subscriptions whose title or body holds ``query``.

    One pass over the text: the needle is tested in the scan and only hits
    are joined to the user's state.
    """
    q = query.strip()
    if not q:
        raise ValueError("query is required")
    hits = entries.filter(matches_query(q)).filter(before_cursor(cursor, F.col("id")))
    subs = subscriptions.filter(F.col("user_id") == user_id).select("feed_id")
    mine = visible_state(state, user_id, False, cursor).join(subs, "feed_id", "left_semi")
    rows = hits.join(mine.select("entry_id", "read_at"), hits["id"] == F.col("entry_id"))
    return _newest(with_pins(rows, pins, user_id).select(*ENTRY_COLUMNS), "id", effective_limit(limit))


def next_cursor(page: DataFrame, limit: int) -> DataFrame:
    """One row with the cursor after a page; null when the page is not full."""
    last = F.min(F.struct("published_at", "id"))
    return page.agg(F.count(F.lit(1)).alias("n"), last.alias("last")).select(
        F.when(F.col("n") == limit, format_cursor(F.col("last.published_at"), F.col("last.id"))).alias(
            "next_cursor"
        )
    )


def trigrams(text: Column) -> Column:
    """Distinct lower-cased 3-character windows of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), F.lit(1)))


def trigram_postings(entries: DataFrame) -> DataFrame:
    """(gram, entry_id) postings over title and body, ready to store by gram."""
    grams = F.array_union(trigrams(F.coalesce("title", F.lit(""))), trigrams(F.coalesce("body", F.lit(""))))
    return entries.select(F.explode(grams).alias("gram"), F.col("id").alias("entry_id"))


def postings_candidates(postings: DataFrame, query: str) -> DataFrame:
    """Ids of entries holding every trigram of ``query`` (verify afterwards)."""
    q = query.lower()
    grams = sorted({q[i : i + 3] for i in range(len(q) - 2)})
    if not grams:
        raise ValueError("a trigram search needs at least 3 characters")
    return (
        postings.filter(F.col("gram").isin(grams))
        .groupBy("entry_id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") == len(grams))
        .select("entry_id")
    )


def search_postings(entries, postings, state, subscriptions, pins, user_id, query, **page):
    """:func:`search` with the text scan narrowed by the trigram postings."""
    ids = postings_candidates(postings, query.strip())
    narrowed = entries.join(ids, entries["id"] == ids["entry_id"], "left_semi")
    return search(narrowed, state, subscriptions, pins, user_id, query, **page)


def entries_by_url(entries: DataFrame, urls: DataFrame) -> DataFrame:
    """For each asked URL the newest entry: (url, id)."""
    newest = F.max(F.struct("published_at", "id"))
    return (
        entries.select("url", "published_at", "id")
        .join(urls.select("url").distinct(), "url", "left_semi")
        .groupBy("url")
        .agg(newest.alias("_m"))
        .select("url", F.col("_m.id").alias("id"))
    )
