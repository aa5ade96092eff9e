"""Timelines, search, subscriptions and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions.items import format_cursor, parse_cursor
from skein.operators import feeds, sources, stats, subscriptions, timeline, unread
from skein.operators import fanout as fan
from skein.operators.timeline import Cursor
from skein.plans.fixtures import DAY, NOW, Fixtures
from skein.plans.registry import query

USER = 7
FEED = 9
CURSOR = Cursor(1705500000, 500)

_E = (
    "e.id, e.feed_id, e.guid, e.url, e.title, e.author, e.body, e.published_at, e.updated_at, e.fetched_at, "
    "u.read_at, p.entry_id IS NOT NULL AS pinned"
)
_FROM = f"""FROM fx_entries e JOIN fx_state u ON u.entry_id = e.id AND u.user_id = {USER}
LEFT JOIN fx_pins p ON p.entry_id = e.id AND p.user_id = {USER}"""
_GROUP = f"""FROM fx_entries e JOIN fx_subs s ON s.feed_id = e.feed_id AND s.user_id = {USER}
JOIN fx_state u ON u.entry_id = e.id AND u.user_id = {USER}
LEFT JOIN fx_pins p ON p.entry_id = e.id AND p.user_id = {USER}"""
_NEWEST = "ORDER BY e.published_at DESC, e.id DESC LIMIT"
_BEFORE = (
    f"(e.published_at < {CURSOR.published_at} OR (e.published_at = {CURSOR.published_at} AND e.id < {CURSOR.id}))"
)


def _base(fx: Fixtures):
    return fx.entries, fx.state(), fx.subs, fx.pins


@query("feed_timeline", f"SELECT {_E} {_FROM} WHERE e.feed_id = {FEED} AND u.ignored = 0 {_NEWEST} 100")
def _(fx):
    return timeline.feed_timeline(fx.entries, fx.state(), fx.pins, USER, FEED)


@query(
    "feed_timeline_unread_after_cursor",
    f"SELECT {_E} {_FROM} WHERE e.feed_id = {FEED} AND u.ignored = 0 AND u.read_at IS NULL AND {_BEFORE} {_NEWEST} 20",
)
def _(fx):
    return timeline.feed_timeline(fx.entries, fx.state(), fx.pins, USER, FEED, True, 20, CURSOR)


@query(
    "feed_unread_capped",
    f"SELECT {_E} {_FROM} WHERE e.feed_id = {FEED} AND u.ignored = 0 AND u.read_at IS NULL {_NEWEST} 500",
)
def _(fx):
    return timeline.feed_timeline(fx.entries, fx.state(), fx.pins, USER, FEED, True, timeline.MAX_LIMIT)


@query(
    "folder_timeline",
    f"SELECT {_E} {_GROUP} WHERE u.ignored = 0 AND s.folder_id = 2 AND u.read_at IS NULL {_NEWEST} 100",
)
def _(fx):
    return timeline.folder_timeline(*_base(fx), USER, 2, True)


@query("unfiled_timeline", f"SELECT {_E} {_GROUP} WHERE u.ignored = 0 AND s.folder_id IS NULL {_NEWEST} 100")
def _(fx):
    return timeline.folder_timeline(*_base(fx), USER, None)


@query("rating_timeline", f"SELECT {_E} {_GROUP} WHERE u.ignored = 0 AND s.rating = 4 AND {_BEFORE} {_NEWEST} 100")
def _(fx):
    return timeline.rating_timeline(*_base(fx), USER, 4, cursor=CURSOR)


_TODAY = f"SELECT {_E}, s.rating {_GROUP} WHERE u.ignored = 0 AND u.read_at IS NULL AND e.created_at >= {NOW - DAY} {_NEWEST} 100"


@query("today_timeline", f"SELECT * EXCLUDE (rating) FROM ({_TODAY}) t")
def _(fx):
    return timeline.today_timeline(*_base(fx), USER, NOW)


@query(
    "today_by_rating",
    f"SELECT *, row_number() OVER (ORDER BY rating DESC, published_at DESC, id DESC) AS position FROM ({_TODAY}) t",
)
def _(fx):
    entries, state, subs, pins = _base(fx)
    return timeline.today_by_rating(timeline.today_timeline(entries, state, subs, pins, USER, NOW), subs, USER)


@query(
    "unread_first_pages",
    """SELECT user_id, rn, entry_id, feed_id, url, title, published_at, pinned FROM (
  SELECT u.user_id, row_number() OVER (PARTITION BY u.user_id ORDER BY u.published_at DESC, u.entry_id DESC) AS rn,
    u.entry_id, u.feed_id, e.url, e.title, u.published_at, p.entry_id IS NOT NULL AS pinned
  FROM fx_state u JOIN fx_entries e ON e.id = u.entry_id
  LEFT JOIN fx_pins p ON p.entry_id = u.entry_id AND p.user_id = u.user_id
  WHERE u.ignored = 0 AND u.read_at IS NULL) t WHERE rn <= 100""",
)
def unread_first_pages(fx):
    near = unread.newest_unread(fx.open_entries(), fx.subs, fx.words, fx.own_reads(), 100)
    rows = near.withColumns({"read_at": F.lit(None), "ignored": F.lit(0)})
    return timeline.first_pages(fx.entries, rows, fx.pins, 100)


_SEARCH = f"SELECT {_E} {_GROUP} WHERE u.ignored = 0 AND ({{}}) {_NEWEST} 100"


def _ci(needle: str) -> str:
    return f"contains(lower(e.title), lower('{needle}')) OR contains(lower(e.body), lower('{needle}'))"


@query("search_literal", _SEARCH.format(_ci("TIONEN")))
def _(fx):
    return timeline.search(*_base(fx), USER, "TIONEN")


@query("search_postings", _SEARCH.format(_ci("ón con")))
def _(fx):
    return timeline.search_postings(
        fx.entries, fx.postings(), fx.state(), fx.subs, fx.pins, USER, "ón con"
    )


@query(
    "search_short_like",
    _SEARCH.format(
        "translate(e.title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%q_%'"
        " OR translate(e.body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%q_%'"
    ),
)
def _(fx):
    return timeline.search(*_base(fx), USER, "Q_")


@query(
    "search_next_cursor",
    f"""SELECT CASE WHEN count(*) = 100 THEN concat(CAST(min(published_at) AS STRING), ',',
  CAST(arg_min(id, published_at * 10000000 + id) AS STRING)) END AS next_cursor
FROM (SELECT e.id, e.published_at {_GROUP} WHERE u.ignored = 0 AND ({_ci("the")}) {_NEWEST} 100) t""",
)
def _(fx):
    return timeline.next_cursor(timeline.search(*_base(fx), USER, "the", 100), 100)


@query(
    "trigram_document_frequency",
    """SELECT gram, count(*) AS entries FROM (SELECT DISTINCT id, unnest(list_transform(range(1, len(c) - 1),
  lambda i: concat(c[i], c[i + 1], c[i + 2]))) AS gram FROM (
    SELECT id, string_split(lower(title), '') AS c FROM fx_entries
    UNION ALL SELECT id, string_split(lower(body), '') AS c FROM fx_entries) a) g GROUP BY gram""",
)
def _(fx):
    return fx.postings().groupBy("gram").agg(F.count(F.lit(1)).alias("entries"))


@query(
    "entry_by_url",
    """SELECT url, id FROM (SELECT url, id, row_number() OVER (PARTITION BY url ORDER BY published_at DESC, id DESC) AS rn
  FROM fx_entries WHERE url IN (SELECT url FROM fx_pins)) t WHERE rn = 1""",
)
def _(fx):
    return timeline.entries_by_url(fx.entries, fx.pins)


@query("cursor_roundtrip", "SELECT id, concat(CAST(published_at AS STRING), ',', CAST(id AS STRING)) AS cursor, published_at AS pub, id AS entry FROM fx_entries")
def _(fx):
    c = fx.entries.select("id", format_cursor(F.col("published_at"), F.col("id")).alias("cursor"))
    parsed = parse_cursor(F.col("cursor"))
    return c.select("id", "cursor", parsed["published_at"].alias("pub"), parsed["id"].alias("entry"))


@query("fan_out", "SELECT user_id, entry_id, feed_id, published_at, created_at, ignored FROM fx_state")
def _(fx):
    return fan.fan_out(fx.entries, fx.subs, fx.words).drop("read_at")


@query("ignored_pairs", "SELECT user_id, entry_id FROM fx_state WHERE ignored = 1")
def _(fx):
    return fan.ignored_pairs(fx.entries, fx.subs, fx.words)


@query("subscription_views", "SELECT * FROM fx_views")
def _views(fx):
    return subscriptions.subscription_views(fx.counted_subs(), fx.feeds, fx.entries, fx.fulltext)


@query("unread_subscription_views", "SELECT * FROM fx_views WHERE unread_count > 0")
def _(fx):
    return subscriptions.with_unread_only(_views(fx))


@query("unread_counts", "SELECT user_id, feed_id, unread_count FROM fx_counted")
def _(fx):
    return fx.counted_subs().select("user_id", "feed_id", "unread_count")


@query(
    "feed_manager_filter",
    """SELECT * FROM fx_views WHERE kind = 'feed' AND error_count >= 3 AND contains(lower(feed_url), 'example')
  AND contains(lower(coalesce(last_error, '')), 'status 500') AND (contains(lower(title), 'src1')
  OR contains(lower(feed_url), 'src1') OR contains(lower(site_url), 'src1'))""",
)
def _(fx):
    return subscriptions.filter_views(
        _views(fx), "feed", True, 3, "EXAMPLE", "Status 500", "SRC1"
    )


@query(
    "group_counters",
    """SELECT user_id, scope, bucket, sum(unread_count)::BIGINT AS unread, count(*) AS feeds, count(*) FILTER (error_count >= 3) AS erroring
FROM (SELECT user_id, unread_count, error_count, 'all' AS scope, '' AS bucket FROM fx_views
  UNION ALL SELECT user_id, unread_count, error_count, 'folder', CAST(coalesce(folder_id, 0) AS STRING) FROM fx_views
  UNION ALL SELECT user_id, unread_count, error_count, 'rating', CAST(rating AS STRING) FROM fx_views
  UNION ALL SELECT user_id, unread_count, error_count, 'kind', kind FROM fx_views) t GROUP BY user_id, scope, bucket""",
)
def _(fx):
    return subscriptions.group_counters(_views(fx))


_SORT = "CASE WHEN unread_count > 0 THEN 0 ELSE 1 END, coalesce(last_entry_at, 0) DESC, coalesce(nullif(title, ''), feed_url), feed_id"
_BY_FOLDER = f"""SELECT v.user_id, v.feed_id, v.unread_count, coalesce(f.name, '(未分類)') AS group_name,
  row_number() OVER (PARTITION BY v.user_id ORDER BY f.sort_order NULLS LAST, f.name, {_SORT.replace("title", "v.title").replace("feed_id", "v.feed_id")}) AS position
FROM fx_views v LEFT JOIN fx_folders f ON f.user_id = v.user_id AND f.id = v.folder_id"""


@query("sidebar_by_folder", _BY_FOLDER)
def _sidebar(fx):
    side = subscriptions.sidebar_by_folder(_views(fx), fx.folders)
    return side.select("user_id", "feed_id", "unread_count", "group_name", "position")


@query(
    "sidebar_by_rating",
    f"SELECT user_id, feed_id, rating, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, {_SORT}) AS position FROM fx_views",
)
def _(fx):
    return subscriptions.sidebar_by_rating(_views(fx)).select("user_id", "feed_id", "rating", "position")


@query(
    "adjacent_unread_feeds",
    f"""SELECT user_id, feed_id, position,
  (SELECT b.feed_id FROM side b WHERE b.user_id = a.user_id AND b.unread_count > 0 AND b.position < a.position ORDER BY b.position DESC LIMIT 1) AS prev_unread,
  (SELECT b.feed_id FROM side b WHERE b.user_id = a.user_id AND b.unread_count > 0 AND b.position > a.position ORDER BY b.position LIMIT 1) AS next_unread
FROM (SELECT * FROM ({_BY_FOLDER}) s) a""".replace("side b", f"({_BY_FOLDER}) b"),
)
def _(fx):
    return subscriptions.adjacent_unread(_sidebar(fx)).select(
        "user_id", "feed_id", "position", "prev_unread", "next_unread"
    )


@query("pins_newest_first", f"SELECT * FROM fx_pins WHERE user_id = {USER}")
def _(fx):
    from skein.operators.marks import newest_first

    return newest_first(fx.pins, USER, "entry_id")


@query("ignore_words_newest_first", f"SELECT * FROM fx_words WHERE user_id = {USER}")
def _(fx):
    from skein.operators.marks import newest_first

    return newest_first(fx.words, USER, "word")


@query("folder_list", "SELECT user_id, id, name, sort_order, row_number() OVER (PARTITION BY user_id ORDER BY sort_order, name) AS position FROM fx_folders")
def _(fx):
    from skein.skew import sliced_rank

    return sliced_rank(
        fx.folders, ["user_id"], ["sort_order"], [F.asc("sort_order")], [F.asc("name")], "position"
    )


@query("feed_lookup", "SELECT * FROM fx_feeds WHERE id IN (SELECT feed_id FROM fx_fulltext)")
def _(fx):
    return sources.by_keys(fx.feeds, "id", fx.fulltext.withColumnRenamed("feed_id", "id"))


_DUE = f"""SELECT f.id, f.feed_url, f.next_fetch_at FROM fx_feeds f WHERE next_fetch_at <= {NOW} AND error_count < 20
  AND EXISTS (SELECT 1 FROM fx_subs s WHERE s.feed_id = f.id) ORDER BY next_fetch_at, id LIMIT 200"""


@query("due_feeds", _DUE)
def _(fx):
    return feeds.due_feeds(fx.feeds, fx.subs, NOW, 200).select("id", "feed_url", "next_fetch_at")


@query(
    "today_unread",
    f"SELECT user_id, count(*) AS today_unread FROM fx_state WHERE ignored = 0 AND read_at IS NULL AND created_at >= {NOW - DAY} GROUP BY user_id",
)
def _(fx):
    return stats.today_unread(fx.state(), NOW)


_STATS = """SELECT s.user_id, count(*) AS feeds_total, count(*) FILTER (f.error_count > 0) AS feeds_erroring,
  sum(s.unread_count)::BIGINT AS entries_unread FROM fx_counted s JOIN fx_feeds f ON f.id = s.feed_id GROUP BY s.user_id"""


@query("user_stats", _STATS)
def _(fx):
    return stats.user_stats(fx.counted_subs(), fx.feeds)


@query("erroring_feeds", "SELECT * FROM fx_views WHERE error_count > 0")
def _(fx):
    return stats.erroring_views(_views(fx))


@query("queue_depth", f"SELECT count(*) AS queue_depth FROM fx_feeds WHERE next_fetch_at <= {NOW} AND error_count < 20")
def _(fx):
    return stats.queue_depth(fx.feeds, NOW)


@query("fetch_counters", "SELECT status, count(*) AS fetches FROM fx_log GROUP BY status")
def _(fx):
    return stats.fetch_counters(fx.log)


_LE = "(VALUES ('0.1', 0.1), ('0.25', 0.25), ('0.5', 0.5), ('1', 1), ('2.5', 2.5), ('5', 5), ('10', 10), ('30', 30), ('60', 60), ('+Inf', 1e300)) b(le, v)"


@query(
    "fetch_duration_histogram",
    f"SELECT le, (SELECT count(*) FROM fx_log l WHERE l.duration_s <= b.v) AS observations FROM {_LE}",
)
def _(fx):
    return stats.duration_histogram(fx.log)


@query("fetch_duration_totals", "SELECT round(sum(duration_s), 5) AS duration_sum, count(*) AS duration_count FROM fx_log")
def _(fx):
    totals = stats.duration_totals(fx.log)
    return totals.select(F.round("duration_sum", 5).alias("duration_sum"), "duration_count")


@query(
    "crawl_summary",
    "SELECT count(*) AS feeds, sum(new_entries)::BIGINT AS new_entries, count(*) FILTER (status IN ('error', 'gone')) AS errors FROM fx_log",
)
def _(fx):
    return stats.crawl_summary(fx.log)


@query("recent_errors", "SELECT * FROM fx_log WHERE status = 'internal' ORDER BY at_s DESC, seq DESC LIMIT 50")
def _(fx):
    return stats.recent_errors(fx.log)


@query(
    "recent_errors_of_subscribed",
    f"""SELECT * FROM (SELECT * FROM fx_log WHERE status = 'internal' ORDER BY at_s DESC, seq DESC LIMIT 50) t
WHERE feed_id IN (SELECT feed_id FROM fx_subs WHERE user_id = {USER})""",
)
def _(fx):
    return subscriptions.subscribed_only(stats.recent_errors(fx.log), fx.subs, USER)


@query(
    "gauges",
    f"""SELECT 'feeds_total' AS name, feeds_total AS value FROM ({_STATS}) s WHERE user_id = {USER}
UNION ALL SELECT 'feeds_erroring', feeds_erroring FROM ({_STATS}) s WHERE user_id = {USER}
UNION ALL SELECT 'entries_unread', entries_unread FROM ({_STATS}) s WHERE user_id = {USER}
UNION ALL SELECT 'queue_depth', count(*) FROM fx_feeds WHERE next_fetch_at <= {NOW} AND error_count < 20
UNION ALL SELECT 'crawler_internal_errors_recent', least(50, (SELECT count(*) FROM fx_log WHERE status = 'internal'))""",
)
def _(fx):
    mine = stats.user_stats(fx.counted_subs().filter(F.col("user_id") == USER), fx.feeds)
    return stats.gauges(mine, stats.queue_depth(fx.feeds, NOW), stats.recent_errors(fx.log))


@query(
    "quota_usage",
    """SELECT user_id, 'subscriptions' AS resource, count(*) AS n, count(*) >= 10 AS exceeded FROM fx_subs GROUP BY user_id
UNION ALL SELECT user_id, 'pins', count(*), false FROM fx_pins GROUP BY user_id
UNION ALL SELECT user_id, 'ignore_words', count(*), count(*) >= 2 FROM fx_words GROUP BY user_id""",
)
def _(fx):
    return stats.usage(
        {"subscriptions": fx.subs, "pins": fx.pins, "ignore_words": fx.words},
        {"subscriptions": 10, "pins": 0, "ignore_words": 2},
    )
