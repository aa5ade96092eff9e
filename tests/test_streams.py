"""Streams over arriving files equal a plain sequential check."""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict

import pytest
from oracle import TESTDATA
from pyspark.sql import functions as F

from skein.operators import boilerplate
from skein.plans import catalog_streams as cs
from skein.plans.fixtures import page_version_blocks
from skein.sources import dom
from skein.sources.tablestore import TableStore
from skein.streaming import keyed, metrics
from skein.streaming.ingest import batch_time, dedup_items, ingest_handler
from skein.streaming.runner import file_stream, poll, run_to_files

SF_DIR = f"{TESTDATA}/sf0.001"


@pytest.fixture
def arriving(spark, workdir):
    """Split a table into files so that a stream sees several micro-batches."""

    def split(df, order, parts=4):
        folder = f"{workdir}/{uuid.uuid4().hex}"
        low, high = df.agg(F.min(order), F.max(order)).first()
        step = (high - low) / parts
        # One append after the other: files arrive in the order of the data.
        for i in range(parts):
            until = high if i == parts - 1 else low + step * (i + 1)
            part = df.filter((F.col(order) <= until) & ((F.lit(i == 0)) | (F.col(order) > low + step * i)))
            part.coalesce(1).write.mode("append").parquet(folder)
        return file_stream(spark, folder, df.schema, max_files=1)

    return split


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF_DIR}/events.parquet").cache()


@pytest.fixture(scope="module")
def pages(spark):
    # Few hosts, so that every source has a history.
    df = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    host = F.concat(F.lit("https://h"), (F.col("page_id") % 4).cast("string"), F.lit(".example.com/"))
    return df.withColumn("url", host).withColumn("page_id", F.col("page_id")).cache()


def test_chained_intervals(arriving, events):
    log = cs.interval_events(events)
    got = {(r.feed_id, r.seq): (r.interval_sec, r.error_count) for r in run_to_files(keyed.chained_intervals(arriving(log, "seq")), "t").collect()}
    held, want = {}, {}
    for r in log.orderBy("seq").collect():
        cur, errors = held.get(r.feed_id, (1800, 0))
        held[r.feed_id] = keyed.next_interval(cur, errors, r.status, r.new_entries, r.retry_after, r.jitter)
        want[r.feed_id, r.seq] = held[r.feed_id]
    assert got == want


def test_interval_step_equals_the_column_form(spark, rows):
    from skein.operators import feeds

    cases = rows(
        "status string, cur bigint, n bigint, errors bigint, retry bigint, jitter bigint",
        [(s, c, n, e, r, 11) for s in ("ok", "not_modified", "error") for c in (0, 600, 1801, 40001) for n in (0, 2) for e in (0, 3, 12) for r in (0, 90, 10**6)],
    )
    ok = F.col("status").isin("ok", "not_modified")
    found = (F.col("status") == "ok") & (F.col("n") > 0)
    col = F.when(ok, feeds.success_interval(F.col("cur"), found)).otherwise(
        feeds.error_interval(F.col("cur"), F.col("errors") + 1, F.col("retry"), F.col("jitter"))
    )
    for r in cases.withColumn("v", col).collect():
        assert keyed.next_interval(r.cur, r.errors, r.status, r.n, r.retry, r.jitter)[0] == r.v, r


def test_page_watch(arriving, pages):
    versions = cs.page_versions(page_version_blocks(pages))
    got = {(r.source, r.version): (r.decision, r.n_added, r.n_removed) for r in run_to_files(keyed.watch_versions(arriving(versions, "version")), "t").collect()}
    held, want = {}, {}
    for r in versions.orderBy("version").collect():
        old, new = held.get(r.source), list(r["keys"])
        if old is None:
            want[r.source, r.version] = ("started", 0, 0)
        elif old == new:
            want[r.source, r.version] = ("unchanged", 0, 0)
        else:
            a, b = Counter(new) - Counter(old), Counter(old) - Counter(new)
            want[r.source, r.version] = ("changed" if a else "hidden", sum(a.values()), sum(b.values()))
        held[r.source] = new
    assert got == want


def test_flapping_page_repeats_its_entry_id(arriving, rows):
    versions = rows("source string, version bigint, keys array<string>", [("s", 1, ["a"]), ("s", 2, ["a", "b"]), ("s", 3, ["a"]), ("s", 4, ["a", "b"])])
    got = {r.version: (r.decision, r.guid) for r in run_to_files(keyed.watch_versions(arriving(versions, "version", 2)), "t").collect()}
    assert [got[v][0] for v in (1, 2, 3, 4)] == ["started", "changed", "hidden", "changed"]
    assert got[2][1] == got[4][1] != got[1][1]


def test_third_article_failure_gives_up(arriving, rows):
    crawls = rows(
        "source string, crawl bigint, urls array<string>, failing array<string>, max_items int",
        [("s", i, ["u1", "u2", "u3"], ["u2"], 2) for i in range(1, 6)],
    )
    got = sorted((r.crawl, r.url, r.action, r.failures) for r in run_to_files(keyed.listing_crawls(arriving(crawls, "crawl", 3)), "t").collect())
    # u3 was beyond the first crawl's limit and is sealed, never imported.
    assert got == [(1, "u1", "imported", 0), (1, "u2", "failed", 1), (2, "u2", "failed", 2), (3, "u2", "title_only", 2)]


def test_seen_list_eviction_spares_listed_urls():
    seen = [f"s{i}" for i in range(keyed.listing.MAX_SEEN)]
    order, pending, actions = keyed.fold_listing(seen, {"gone": 1}, ["new1", "s0", "new2"], set(), 20, False)
    assert len(order) == keyed.listing.MAX_SEEN and order[-2:] == ["new1", "new2"]
    assert pending == {} and [a[1] for a in actions] == ["imported", "imported"]


def test_learned_boilerplate_equals_the_rule(arriving, pages):
    packed = dom.page_digests(cs.feed_pages(pages), boilerplate.MAX_DEPTH, 4)
    stream = dom.page_digests(cs.feed_pages(arriving(pages, "page_id")), boilerplate.MAX_DEPTH, 4)
    got = {(r.page_id, r.pos) for r in run_to_files(keyed.learned_cuts(stream), "t").collect()}
    states, want = defaultdict(lambda: ({}, 0)), set()
    for r in packed.orderBy("page_id").collect():
        counts, n = states[r.feed_id]
        subtrees = sorted((s.pos, s.end, s.sig, s.text_len, s.link_len) for s in r.subtrees)
        counts, n, cut = keyed.fold_page(counts, n, subtrees)
        states[r.feed_id] = (counts, n)
        want |= {(r.page_id, pos) for pos, _ in cut}
    assert got == want


def test_boilerplate_decays_and_forgets():
    counts, pages, cut = {}, 0, []
    nav = (3, 9, "nav", 100, 90)
    for _ in range(5):
        counts, pages, cut = keyed.fold_page(counts, pages, [nav, (4, 5, "inner", 50, 50)])
    assert cut == [(3, "nav")]
    # Once cut, the inside of a block is no longer counted.
    assert counts["inner"][0] == 2
    for _ in range(200):
        counts, pages, cut = keyed.fold_page(counts, pages, [(3, 9, "other", 100, 90)])
    assert pages < boilerplate.DECAY_PAGES and "nav" not in counts


def test_metrics_stream_equals_batch(arriving, events):
    batch = {(r.hour, r.status): r.le_inf for r in metrics.fetch_metrics(cs.event_log(events)).collect()}
    out = run_to_files(metrics.fetch_metrics(cs.event_log(arriving(events, "event_id"))), "t")
    got = {(r.hour, r.status): r.le_inf for r in out.collect()}
    # The last windows stay open until later data moves the watermark.
    assert got.items() <= batch.items() and len(batch) - len(got) < 10


def test_dedup_keeps_one(arriving, events):
    items = events.selectExpr("event_id % 7 AS feed_id", "CAST(event_id % 10 AS STRING) AS guid", "CAST(ts AS TIMESTAMP) AS at")
    out = run_to_files(dedup_items(arriving(items.withColumn("n", F.unix_seconds("at")), "n"), "at", "400 days").select("feed_id", "guid"), "t")
    assert out.count() == out.distinct().count() == items.select("feed_id", "guid").distinct().count()


RSS = """<rss version="2.0"><channel><title>Feed {0}</title><link>https://f{0}.example.com/</link>{1}</channel></rss>"""
ITEM = "<item><title>T{0}</title><guid>g{0}</guid><link>/a{0}</link><description>body {0}</description><pubDate>Mon, 01 Jan 2024 00:0{0}:00 GMT</pubDate></item>"


def rss(feed, items):
    return bytearray(RSS.format(feed, "".join(ITEM.format(i) for i in items)).encode())


FETCHED = (
    "feed_id bigint, feed_url string, http_status int, body binary, retry_after bigint, new_feed_url string, "
    "etag string, last_modified string, at_s bigint"
)
FEEDS = (
    "id bigint, feed_url string, site_url string, title string, etag string, last_modified string, body_hash string, "
    "fetch_interval_sec bigint, next_fetch_at bigint, last_fetched_at bigint, last_success_at bigint, last_status int, "
    "error_count bigint, last_error string, created_at bigint, updated_at bigint"
)
T0 = 1_704_070_000


def start_store(spark, rows, root):
    from test_reader_rules import ENTRY, STATE, SUBS, WORDS, sub

    store = TableStore(spark, root)
    feed_rows = [(i, f"https://f{i}.example.com/rss", "", "", None, None, None, 1800, T0, None, None, None, 0, None, 0, 0) for i in (1, 2, 3)]
    store.publish(
        {
            "feeds": rows(FEEDS, feed_rows), "entries": rows(ENTRY, []), "state": rows(STATE, []),
            "subscriptions": rows(SUBS, [sub(7, 1), sub(8, 1), sub(7, 2)]), "ignore_words": rows(WORDS, [(8, "t2", 0)]),
        }
    )
    return store


def test_polling_ingests_each_response_once(spark, rows, workdir):
    store = start_store(spark, rows, f"{workdir}/store")
    inbox = f"{workdir}/in"
    first = [
        (1, "https://f1.example.com/rss", 200, rss(1, [1, 2]), 0, None, "e1", "", T0), (2, "https://f2.example.com/rss", 200, bytearray(b"<html>login"), 0, None, "", "", T0),
        (3, "https://f3.example.com/rss", 410, bytearray(b""), 0, None, "", "", T0),
    ]
    second = [(1, "https://f1.example.com/rss", 200, rss(1, [2, 3]), 0, None, "", "", T0 + 900), (2, "https://f2.example.com/rss", 503, bytearray(b""), 120, None, "", "", T0 + 900)]
    rows(FETCHED, first).coalesce(1).write.parquet(inbox)
    handle = ingest_handler(store, batch_time)

    def drain():
        stream = file_stream(spark, inbox, rows(FETCHED, first).schema, max_files=1)
        query = poll(stream, handle, f"{workdir}/checkpoint", once=True)
        query.awaitTermination()

    drain()
    feeds = {r.id: r for r in store.read("feeds").collect()}
    assert (feeds[1].title, feeds[1].site_url, feeds[1].etag, feeds[1].error_count) == ("Feed 1", "https://f1.example.com/", "e1", 0)
    assert feeds[1].fetch_interval_sec == 1260 and feeds[1].next_fetch_at == T0 + 1260
    assert feeds[2].error_count == 1 and feeds[2].last_error and feeds[3].error_count == 20
    entries = {r.guid: r for r in store.read("entries").collect()}
    assert set(entries) == {"g1", "g2"} and entries["g1"].url == "https://f1.example.com/a1"
    subs = {(r.user_id, r.feed_id): r.unread_count for r in store.read("subscriptions").collect()}
    assert subs == {(7, 1): 2, (8, 1): 1, (7, 2): 0}

    rows(FETCHED, second).coalesce(1).write.mode("append").parquet(inbox)
    drain()
    feeds = {r.id: r for r in store.read("feeds").collect()}
    assert feeds[1].etag == "e1" and feeds[2].error_count == 2 and feeds[2].next_fetch_at == T0 + 900 + 120
    assert {r.guid for r in store.read("entries").collect()} == {"g1", "g2", "g3"}
    assert store.read("state").count() == 6
    version = store.current()["version"]
    # A replayed batch changes nothing.
    handle(rows(FETCHED, second), store.current()["batch"])
    assert store.current()["version"] == version


def test_all_responses_of_a_batch_count_in_order(spark, rows, workdir):
    store = start_store(spark, rows, f"{workdir}/store")
    url = "https://f1.example.com/rss"
    both = [
        (1, url, 503, bytearray(b""), 0, None, "", "", T0 + 900),
        (1, url, 200, rss(1, [2, 3]), 0, None, "e2", "", T0 + 1800),
        (1, url, 200, rss(1, [1, 2]), 0, None, "e1", "", T0),
    ]
    ingest_handler(store, batch_time)(rows(FETCHED, both), 0)
    assert {r.guid for r in store.read("entries").collect()} == {"g1", "g2", "g3"}
    feed = {r.id: r for r in store.read("feeds").collect()}[1]
    assert feed.etag == "e2" and feed.error_count == 0 and feed.last_fetched_at == T0 + 1800
