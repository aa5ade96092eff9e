"""Table rules on small hand-made frames."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skein.operators import fanout, feeds, ingest, marks, retention, subscriptions, timeline

NOW = 1_700_000_000
ENTRY = (
    "id bigint, feed_id bigint, guid string, url string, title string, author string, body string, "
    "published_at bigint, updated_at bigint, fetched_at bigint, created_at bigint"
)
STATE = (
    "user_id bigint, entry_id bigint, feed_id bigint, published_at bigint, created_at bigint, "
    "read_at bigint, ignored int"
)
SUBS = (
    "user_id bigint, feed_id bigint, folder_id bigint, title string, rating bigint, unread_count bigint, "
    "sort_order bigint, created_at bigint"
)
WORDS = "user_id bigint, word string, created_at bigint"
PINS = "user_id bigint, entry_id bigint, url string, title string, created_at bigint"
BATCH = (
    "feed_id bigint, pos bigint, guid string, url string, title string, author string, body string, "
    "published_at bigint, updated_at bigint, date_missing boolean"
)


def entry(i, feed=1, guid=None, title="t", body="b", at=None):
    at = NOW - 1000 * i if at is None else at
    return (i, feed, guid or f"g{i}", f"u{i}", title, "", body, at, at, at, at)


def sub(user, feed, unread=0):
    return (user, feed, None, "", 0, unread, 0, 0)


def item(pos, guid, title="t", missing=False, feed=1, body="b"):
    return (feed, pos, guid, f"u-{guid}", title, "", body, NOW - pos, NOW - pos, missing)


@pytest.fixture
def tables(rows):
    def make(entries=(), state=(), subs=(), words=(), pins=()):
        return (
            rows(ENTRY, list(entries)), rows(STATE, list(state)), rows(SUBS, list(subs)),
            rows(WORDS, list(words)), rows(PINS, list(pins)),
        )

    return make


def test_reseen_item_keeps_dates_and_reads(tables, rows):
    entries, state, subs, words, _ = tables(
        [entry(1, title="old")], [(7, 1, 1, NOW - 1000, NOW - 1000, 55, 0)], [sub(7, 1)]
    )
    out = ingest.upsert_entries(entries, state, subs, words, rows(BATCH, [item(0, "g1", "new")]), NOW)
    row = out.entries.first()
    assert (row.title, row.published_at, row.created_at, row.fetched_at) == ("new", NOW - 1000, NOW - 1000, NOW)
    assert [tuple(r) for r in out.state.collect()] == [(7, 1, 1, NOW - 1000, NOW - 1000, 55, 0)]


def test_repeated_item_inserts_first_and_shows_last(tables, rows):
    entries, state, subs, words, _ = tables([], [], [sub(7, 1)], [(7, "first", 0)])
    batch = rows(BATCH, [item(0, "a", "first copy"), item(5, "a", "last copy")])
    out = ingest.upsert_entries(entries, state, subs, words, batch, NOW)
    row = out.entries.first()
    assert (row.title, row.published_at) == ("last copy", NOW)
    # The ignore flag comes from the inserted copy and is not recomputed.
    assert out.state.first().ignored == 1


def test_dateless_backlog_leaves_only_first_unread(tables, rows):
    entries, state, subs, words, _ = tables([], [], [sub(7, 1)])
    batch = rows(BATCH, [item(i, f"n{i}", missing=True) for i in range(4)])
    out = ingest.upsert_entries(entries, state, subs, words, batch, NOW)
    assert out.state.filter("read_at IS NULL").count() == 1
    assert out.subscriptions.first().unread_count == 1


def test_known_first_dateless_item_marks_all_new_ones_read(tables, rows):
    entries, state, subs, words, _ = tables([entry(1, guid="n0")], [], [sub(7, 1)])
    batch = rows(BATCH, [item(i, f"n{i}", missing=True) for i in range(3)])
    out = ingest.upsert_entries(entries, state, subs, words, batch, NOW)
    assert out.state.filter("read_at IS NULL").count() == 0


def test_counters_of_untouched_feeds_stay(tables, rows):
    entries, state, subs, words, _ = tables([], [], [sub(7, 1), sub(7, 2, unread=42)])
    out = ingest.upsert_entries(entries, state, subs, words, rows(BATCH, [item(0, "a")]), NOW)
    assert {(r.feed_id, r.unread_count) for r in out.subscriptions.collect()} == {(1, 1), (2, 42)}


@pytest.mark.parametrize(
    ("word", "title", "hit"),
    [
        ("Baseball", "BASEBALL news", 1), ("a_c", "xabcx", 1), ("a%c", "a--c", 1), ("à", "ÀB", 0), ("À", "xÀB", 1),
        ("end\\", "the END\\ here", 1), ("end\\", "the end", 0), ("_", "x", 1), ("b.d", "bad", 0), ("50%", "50 of", 1),
        ("k", "K", 0), ("i", "İ", 0), ("Σ", "ΑΣ", 1),
    ],
)
def test_ignore_words_follow_sqlite_like(tables, word, title, hit):
    entries, _, subs, words, _ = tables([entry(1, title=title, body="")], [], [sub(7, 1)], [(7, word, 0)])
    assert fanout.fan_out(entries, subs, words).first().ignored == hit


def test_word_groups_match_a_plain_check(tables):
    words = [(u, f"w{i:03d}x", 0) for u in (1, 2) for i in range(400)]
    texts = [entry(i, title=f"has w{i * 37 % 600:03d}x inside") for i in range(40)]
    entries, _, subs, wdf, _ = tables(texts, [], [sub(1, 1), sub(2, 1), sub(3, 1)], words)
    got = {(r.user_id, r.entry_id) for r in fanout.ignored_pairs(entries, subs, wdf).collect()}
    assert got == {(u, i) for u in (1, 2) for i in range(40) if i * 37 % 600 < 400}


def test_fan_out_rows_take_columns_of_entry_and_subscription(tables):
    entries, _, subs, words, _ = tables([entry(1), entry(2)], [], [sub(7, 1, unread=3), sub(8, 1, unread=4)])
    got = fanout.fan_out(entries, subs, words, entry_columns=["guid"], user_columns=["unread_count"])
    want = {(7, 1, "g1", 3), (7, 2, "g2", 3), (8, 1, "g1", 4), (8, 2, "g2", 4)}
    assert {(r.user_id, r.entry_id, r.guid, r.unread_count) for r in got.collect()} == want


def test_choosing_new_items_reads_no_text_that_is_not_asked_for(tables, rows):
    entries, *_ = tables([])
    new = ingest.new_items(rows(BATCH, [item(0, "a"), item(1, "a"), item(2, "b")]), entries, NOW)
    slim = new.select("feed_id", "guid", "published_at")
    plan = slim._jdf.queryExecution().optimizedPlan().toString()
    assert "body" not in plan.split("LogicalRDD")[0]
    assert {tuple(r) for r in slim.collect()} == {(1, "a", NOW), (1, "b", NOW - 2)}


def test_new_subscriber_gets_backlog_with_entry_times(tables):
    entries, state, subs, words, _ = tables(
        [entry(1), entry(2)], [(7, 1, 1, 5, 5, 99, 1)], [sub(7, 1)]
    )
    got = fanout.backfill_new_subscribers(entries, subs, words, state).collect()
    assert [(r.entry_id, r.created_at, r.read_at) for r in got] == [(2, NOW - 2000, None)]


def test_backfill_compares_only_pairs_that_hold_a_part(tables, rows):
    # 7 holds all of feed 1, 8 a part of it, 9 nothing.
    held = [(7, 1, 1, 0, 0, None, 0), (7, 2, 1, 0, 0, None, 0), (8, 2, 1, 0, 0, None, 0)]
    entries, state, subs, words, _ = tables([entry(1), entry(2)], held, [sub(u, 1) for u in (7, 8, 9)])

    def missing(users):
        got = fanout.backfill_new_subscribers(entries, subs.filter(F.col("user_id").isin(users)), words, state)
        return {(r.user_id, r.entry_id) for r in got.collect()}, got._jdf.queryExecution().optimizedPlan().toString()

    assert missing([7, 8, 9])[0] == {(8, 1), (9, 1), (9, 2)}
    found, plan = missing([7, 9])
    assert found == {(9, 1), (9, 2)} and "LeftAnti" not in plan


def test_reignoring_where_rows_say_so_equals_the_join(tables, rows):
    entries, _, subs, old, _ = tables(
        [entry(1, title="spam"), entry(2, title="ham")], [], [sub(7, 1, unread=1), sub(8, 1, unread=1)], [(7, "ham", 0), (8, "ham", 0)]
    )
    new, who = rows(WORDS, [(7, "spam", 0), (8, "spam", 0)]), rows("user_id bigint", [(7,)])
    want = marks.recompute_ignored(fanout.fan_out(entries, subs, old), subs, entries, new, who)
    hits = {"_rehit": fanout.ignored_pairs(entries, subs, new).withColumn("value", F.lit(1))}
    got = marks.reignore_where(
        fanout.fan_out(entries, subs, old, marks=hits), subs, F.col("user_id") == 7, F.coalesce("_rehit", F.lit(0))
    )
    for one, other in zip(got, want, strict=True):
        assert sorted(map(tuple, one.select(*other.columns).collect())) == sorted(map(tuple, other.collect()))


@pytest.mark.parametrize("limit", [1, 3, 20, 100])
def test_page_cuts_drop_no_row_of_a_first_page(tables, limit):
    texts = [entry(i, at=NOW - i // 3 if i < 45 else None) for i in range(50)]
    entries, _, subs, words, pins = tables(texts, [], [sub(7, 1), sub(8, 2)], [(8, "t", 0)])
    state = fanout.fan_out(entries, subs, words)
    cuts = timeline.page_cuts(entries, state, limit)
    near = state.join(cuts, "user_id").filter("_from IS NULL OR published_at >= _from")
    page = timeline.first_pages(entries, near, pins, limit)
    assert sorted(map(repr, page.collect())) == sorted(map(repr, timeline.first_pages(entries, state, pins, limit).collect()))
    assert near.count() <= 3 * limit + 3 or limit > 15


def test_timeline_pages_meet_without_gap_or_repeat(tables):
    # Equal publication times are ordered by id.
    entries, _, subs, words, pins = tables([entry(i, at=NOW - i // 3) for i in range(20)], [], [sub(7, 1)])
    state = fanout.fan_out(entries, subs, words)
    seen, cursor = [], None
    for _ in range(10):
        page = timeline.feed_timeline(entries, state, pins, 7, 1, limit=6, cursor=cursor).collect()
        if not page:
            break
        seen += [r.id for r in page]
        cursor = timeline.Cursor(page[-1].published_at, page[-1].id)
    assert seen == sorted(range(20), key=lambda i: (i // 3, -i))


def test_timeline_hides_ignored_but_marking_does_not(tables):
    entries, state, subs, _, pins = tables(
        [entry(1), entry(2)], [(7, 1, 1, NOW - 1000, 0, None, 1), (7, 2, 1, NOW - 2000, 0, None, 0)], [sub(7, 1)]
    )
    assert [r.id for r in timeline.feed_timeline(entries, state, pins, 7, 1).collect()] == [2]
    assert marks.mark_all_read(state, subs, 7, NOW).affected.first().n == 2


def test_marking_foreign_ids_is_silent(tables, rows):
    _, state, subs, _, _ = tables([], [(7, 1, 1, 0, 0, None, 0)], [sub(7, 1, 1), sub(8, 1, 0)])
    asked = rows("user_id bigint, entry_id bigint", [(7, 1), (7, 999), (8, 1)])
    m = marks.mark_ids_read(state, subs, asked, NOW)
    assert [tuple(r) for r in m.affected.collect()] == [(7, 1)]
    assert {(r.user_id, r.unread_count) for r in m.subscriptions.collect()} == {(7, 0), (8, 0)}


def test_search_is_literal_and_stays_in_one_column(tables):
    entries, _, subs, words, pins = tables(
        [entry(1, title="100% pure", body="x"), entry(2, title="ab", body="cd"), entry(3, title="ÀÉÎ", body="")],
        [], [sub(7, 1)],
    )
    state = fanout.fan_out(entries, subs, words)

    def ids(q):
        return {r.id for r in timeline.search(entries, state, subs, pins, 7, q).collect()}

    assert ids("0% P") == {1} and ids("abcd") == set() and ids("àéî") == {3} and ids("_b") == {2}
    with pytest.raises(ValueError, match="required"):
        timeline.search(entries, state, subs, pins, 7, "  ")


def test_search_is_scoped_to_the_user(tables):
    entries, _, subs, words, pins = tables([entry(1, title="needle")], [], [sub(7, 1)])
    state = fanout.fan_out(entries, subs, words)
    assert timeline.search(entries, state, subs, pins, 8, "needle").count() == 0


def test_age_retention_spares_unread_and_pinned_by_anyone(tables):
    entries, state, subs, _, pins = tables(
        [entry(1), entry(2), entry(3), entry(4)],
        [(7, 1, 1, 0, 0, 5, 0), (8, 1, 1, 0, 0, None, 0), (7, 2, 1, 0, 0, 5, 0), (7, 3, 1, 0, 0, 5, 0)],
        [sub(7, 1)], [], [(8, 3, "u", "t", 0)],
    )
    gone = retention.expired_entries(entries, state, pins, NOW)
    # Entry 4 has no state row at all and qualifies.
    assert {r.id for r in gone.collect()} == {2, 4}


def test_cap_counts_pinned_rows_but_keeps_them(tables):
    entries, state, subs, _, pins = tables([entry(i) for i in range(1, 7)], [], [sub(7, 1)], [], [(7, 5, "u", "t", 0)])
    assert {r.id for r in retention.excess_entries(entries, pins, 3).collect()} == {4, 6}
    out = retention.delete_entries(entries, state, pins, subs, retention.excess_entries(entries, pins, 3))
    assert {r.id for r in out.entries.collect()} == {1, 2, 3, 5}


def test_claimed_feeds_need_subscriber_and_few_errors(rows):
    f = rows(
        "id bigint, next_fetch_at bigint, error_count bigint, fetch_interval_sec bigint",
        [(1, 10, 0, 600), (2, 5, 0, 700), (3, 1, 20, 600), (4, 1, 0, 600), (5, NOW + 1, 0, 600)],
    )
    subs = rows("user_id bigint, feed_id bigint", [(7, 1), (7, 2), (7, 3), (7, 5)])
    assert [r.id for r in feeds.due_feeds(f, subs, NOW, 10).collect()] == [2, 1]
    claimed = {r.id: (r.claimed, r.next_fetch_at) for r in feeds.claim_due_feeds(f, subs, NOW, 1).collect()}
    assert claimed[2] == (True, NOW + 700) and claimed[1] == (False, 10)


@pytest.mark.parametrize(
    ("cur", "new", "want"),
    [(1800, True, 1260), (1800, False, 2340), (0, False, 780), (600, True, 600), (40000, False, 43200), (1001, False, 1301)],
)
def test_success_interval(spark, cur, new, want):
    got = spark.range(1).select(feeds.success_interval(F.lit(cur), F.lit(new)).alias("s")).first().s
    assert got == want


@pytest.mark.parametrize(
    ("cur", "n", "retry", "want"),
    [(1800, 1, 0, 3607), (1800, 20, 0, 86400), (600, 0, 0, 607), (600, 3, 50, 50), (600, 3, 999999, 86400), (0, 1, 0, 1207)],
)
def test_error_interval(spark, cur, n, retry, want):
    got = feeds.error_interval(F.lit(cur), F.lit(n), F.lit(retry), F.lit(7))
    assert spark.range(1).select(got.alias("s")).first().s == want


def test_rating_delta_is_clamped_and_folder_zero_clears(rows):
    subs = rows(SUBS, [(7, 1, 3, "", 5, 0, 0, 0), (7, 2, 3, "x", 1, 0, 0, 0)])
    patches = rows(
        "user_id bigint, feed_id bigint, title string, rating bigint, rating_delta bigint, folder_id bigint",
        [(7, 1, None, None, 1, 0), (7, 2, "y", None, -3, None)],
    )
    got = {r.feed_id: (r.title, r.rating, r.folder_id) for r in subscriptions.patch_subscriptions(subs, patches).collect()}
    assert got == {1: ("", 5, None), 2: ("y", 0, 3)}
