"""Compositions over rounds, stored versions, and the shape of plans."""

from __future__ import annotations

import pytest
from oracle import TESTDATA
from pyspark.sql import functions as F

from skein.operators import blocks, fanout, listing, retention, robots, timeline
from skein.plans import extractors
from skein.plans.fixtures import Fixtures
from skein.plans.listing import listing_round
from skein.plans.nightly import Settings, run
from skein.plans.watch import BASELINE, watch_round
from skein.session import shared_dir
from skein.sources import snapshots
from skein.sources.listing import SELECTORS
from skein.sources.tablestore import TableStore, row_counts

NOW = 1_704_067_200
SF_DIR = f"{TESTDATA}/sf0.001"
BASE_SCHEMA = "source_id bigint, pos int, key string, html string, anchor string, head string"
RUN_SCHEMA = "source_id bigint, rules_version int, config_hash string"


def page(*paragraphs, stamp=""):
    return f"<title>Site</title><div class=header>{stamp}</div>" + "".join(f"<p>{p}</p>" for p in paragraphs)


class Watcher:
    """One source polled again and again."""

    def __init__(self, rows, **settings):
        self.rows, self.settings = rows, settings
        self.baselines, self.runs = rows(BASE_SCHEMA, []), rows(RUN_SCHEMA, [])

    def poll(self, html, **settings):
        source = self.rows("source_id bigint, url string", [(1, "https://w.example.com/")])
        for name, value in {**self.settings, **settings}.items():
            source = source.withColumn(name, F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value))
        pages = self.rows("source_id bigint, html string", [(1, html)])
        entries, baselines, runs, decisions = watch_round(source, pages, self.baselines, self.runs, NOW)
        found = entries.collect()
        decision = decisions.first()
        self.baselines, self.runs = baselines.select(*BASELINE).checkpoint(), runs.checkpoint()
        return decision.decision if decision else None, found


@pytest.fixture
def watcher(spark, rows):
    shared_dir(spark)
    return lambda **s: Watcher(rows, **s)


def test_golden_sequence(watcher):
    w = watcher()
    seen = [
        w.poll(page("a", "b")), w.poll(page("a", "b", "c")), w.poll(page("a", "b", "c", stamp="tick")), w.poll(page("b", "a", "c")), w.poll(page("a", "b")),
    ]
    assert [len(entries) for _, entries in seen] == [1, 1, 0, 0, 0]
    assert [d for d, _ in seen] == ["started", "changed", "unchanged", "hidden", "hidden"]
    first, second = seen[0][1][0], seen[1][1][0]
    assert first.body.startswith(blocks.STARTED_BODY) and "<p>b</p>" in first.body
    assert second.body.startswith("<p>1 ブロック追加 / 0 ブロック削除</p>\n<ins>\n<p>c</p>\n</ins>\n<hr>")
    assert second.title == "Site — 更新 (01/01 00:00)"


def test_changes_mode_shows_removed_blocks(watcher):
    w = watcher(watch_mode="changes", include_full_body=False)
    w.poll(page("a", "b"))
    decision, entries = w.poll(page("a"))
    assert decision == "changed" and entries[0].body == "<p>0 ブロック追加 / 1 ブロック削除</p>\n<del>\n<p>b</p>\n</del>\n"


def test_patterns_mask_and_a_new_pattern_remasks_the_baseline(watcher):
    w = watcher()
    w.poll(page("count 1", "x"))
    decision, _ = w.poll(page("count 2", "x"), ignore_patterns=["[0-9]+"])
    assert decision == "unchanged"
    assert w.poll(page("count 2", "y"), min_change_chars=100)[0] == "below_min"


def test_page_without_content_is_no_poll(watcher):
    w = watcher()
    w.poll(page("a"))
    assert w.poll("<script>x</script>") == (None, [])
    assert w.poll(page("a"))[0] == "unchanged"


def listing_frames(rows, links, articles, **source):
    src = {"source": "s", "url": "https://l.example.com/", "fulltext": True, "max_items_per_crawl": 2, "has_state": True, "state_valid": True, **source}
    sel = {name: "li" if name == "item_selector" else None for name in SELECTORS}
    schema = "source string, url string, fulltext boolean, max_items_per_crawl int, has_state boolean, state_valid boolean, " + ", ".join(f"{n} string" for n in sel)
    html = "<ul>" + "".join(f"<li><a href='/{u}'>Link {u}</a></li>" for u in links) + "</ul>"
    return (
        rows(schema, [(*src.values(), *sel.values())]), rows("source string, html string", [("s", html)]),
        rows("article_id bigint, url string, http_status int, html string", articles),
    )


def state_frames(rows, seen=(), pending=()):
    return (
        rows("source string, url string, seq bigint", [("s", u, i) for i, u in enumerate(seen)]),
        rows("source string, url string, n bigint", [("s", u, n) for u, n in pending]),
    )


@pytest.fixture
def rules(rows):
    files = rows("origin string, body string", [("https://l.example.com", "User-agent: *\nDisallow: /secret")])
    return robots.robots_rules(files, "skein")


L = "https://l.example.com/"
LONG = " ".join(["Sentence with quite some words in it."] * 20)


def test_listing_round(rows, rules, as_set):
    src, pages, arts = listing_frames(
        rows, ["old", "ok", "bad", "late"], [(1, L + "ok", 200, f"<title>Full</title><div><p>{LONG}</p></div>"), (2, L + "bad", 500, "")]
    )
    seen, pending = state_frames(rows, [L + "old"], [(L + "gone", 1)])
    out = listing_round(src, pages, arts, seen, pending, rules, NOW)
    got = out.entries.collect()
    assert [(r.url, r.title) for r in got] == [(L + "ok", "Link ok")] and "Sentence" in got[0].body
    assert as_set(out.state.seen, "url") == {(L + "old",), (L + "ok",)}
    assert as_set(out.state.pending, "url", "n") == {(L + "bad", 1)}


def test_article_of_two_listings_is_extracted_once(rows, rules):
    src, pages, arts = listing_frames(rows, ["ok"], [(1, L + "ok", 200, f"<title>Full</title><div><p>{LONG}</p></div>")])
    second = [df.withColumn("source", F.lit("t")) for df in (src, pages)]
    seen, pending = state_frames(rows, [L + "old"])
    seen = seen.unionByName(seen.withColumn("source", F.lit("t")))
    got = listing_round(src.unionByName(second[0]), pages.unionByName(second[1]), arts, seen, pending, rules, NOW).entries.collect()
    assert sorted((r.source, r.url, r.title) for r in got) == [("s", L + "ok", "Link ok"), ("t", L + "ok", "Link ok")]
    assert all(r.body.count("Sentence") == 20 for r in got)


def test_listing_first_crawl_seals_the_backlog_and_robots_import_by_title(rows, rules, as_set):
    src, pages, arts = listing_frames(rows, ["secret", "a", "b"], [], has_state=False, max_items_per_crawl=1)
    out = listing_round(src, pages, arts, *state_frames(rows), rules, NOW)
    assert as_set(out.entries, "url", "title") == {(L + "secret", "Link secret")}
    assert as_set(out.state.seen, "url") == {(L + "secret",), (L + "a",), (L + "b",)}


def test_listing_resync_seals_without_entries(rows, rules, as_set):
    src, pages, arts = listing_frames(rows, ["a", "b"], [], state_valid=False)
    out = listing_round(src, pages, arts, *state_frames(rows, [L + "junk"]), rules, NOW)
    assert out.entries.count() == 0 and as_set(out.state.seen, "url") == {(L + "a",), (L + "b",)}


def test_extractor_registry(rows, rules):
    assert extractors.kinds() == ["pagewatch", "selector"]
    src, pages, arts = listing_frames(rows, ["a"], [], fulltext=False)
    seen, pending = state_frames(rows)
    items, after = extractors.extract(
        src.withColumn("kind", F.lit("selector")), pages, {"selector": {"articles": arts, "seen": seen, "pending": pending, "rules": rules}}, NOW
    )
    assert [r.url for r in items.collect()] == [L + "a"] and after["selector"]["seen"].count() == 1


def test_table_store_publishes_whole_versions(spark, rows, workdir):
    store = TableStore(spark, f"{workdir}/s")
    assert store.publish({"a": rows("id int", [(1,)]), "b": rows("id int", [(2,)])}, batch=3)
    assert not store.publish({"a": rows("id int", [(9,)])}, batch=3)
    # A version may be computed from the one it replaces.
    assert store.publish({"a": store.read("a").withColumn("id", F.col("id") + 1)}, batch=4, layout={"a": ["id"]})
    assert store.read("a").first().id == 2 and store.read("b").first().id == 2
    assert {tuple(r) for r in row_counts(store.read_all()).collect()} == {("a", 1), ("b", 1)}
    with pytest.raises(KeyError):
        store.read("c")


def test_snapshots(spark, rows, workdir):
    tables = {"feeds": rows("id int", [(1,), (2,)]), "pins": rows("id int", [(3,)])}
    root = f"{workdir}/snap"
    assert snapshots.write_snapshot(tables, root, NOW).endswith("date=20240101")
    assert snapshots.write_snapshot(tables, root, NOW + 60) is None
    listed = snapshots.list_snapshots(spark, root)
    assert listed.count() >= 2 and listed.filter("size_bytes <= 0").count() == 0
    assert spark.read.parquet(f"{root}/date=20240101/feeds").count() == 2
    a, b = rows("name string", [("x-20240101.db",)]), rows("name string", [("x-20240102.db",), ("x-20240101.db",)])
    assert snapshots.latest({"local": b, "remote": b}).first().source == "local"
    assert snapshots.latest({"local": a, "remote": b}).first().name == "x-20240102.db"
    assert snapshots.prune_targets(b, 1).first().name == "x-20240101.db" and snapshots.prune_targets(b, 0).count() == 0


def test_nightly_settings_switch_steps_off(spark, workdir):
    fx = Fixtures(spark, SF_DIR)
    tables = {"feeds": fx.feeds, "entries": fx.entries, "state": fx.state(), "pins": fx.pins, "subscriptions": fx.counted_subs()}
    from skein.plans.fixtures import NOW as FIXTURE_NOW

    same = run(tables, Settings(0, 0, f"{workdir}/snap"), FIXTURE_NOW)
    orphans = retention.orphan_feeds(fx.feeds, fx.subs, FIXTURE_NOW - retention.ORPHAN_GRACE)
    gone = fx.entries.join(orphans.selectExpr("id AS feed_id"), "feed_id").count()
    assert same["entries"].count() == fx.entries.count() - gone
    assert spark.read.parquet(f"{workdir}/snap/date=20240201/entries").count() == same["entries"].count()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_shapes(spark):
    fx = Fixtures(spark, SF_DIR)
    fan = plan_of(fanout.fan_out(fx.entries, fx.subs, fx.words))
    assert "CartesianProduct" not in fan and "NestedLoop" not in fan and "Python" not in fan
    page_plan = plan_of(timeline.feed_timeline(fx.entries, fx.state(), fx.pins, 7, 9))
    assert page_plan.count("TakeOrderedAndProject") == 2 and "Python" not in page_plan
    aged = plan_of(retention.expired_entries(fx.entries, fx.state(), fx.pins, NOW))
    assert aged.count("LeftAnti") == 2 and "Python" not in aged
    cap = plan_of(retention.excess_entries(fx.entries, fx.pins, 20))
    assert "WindowGroupLimit" in cap


def test_stored_timeline_prunes_by_feed(spark, workdir):
    fx = Fixtures(spark, SF_DIR)
    store = TableStore(spark, f"{workdir}/s")
    store.publish({"entries": fx.entries, "state": fx.state(), "pins": fx.pins}, layout={"entries": ["feed_id", "published_at"]})
    df = timeline.feed_timeline(store.read("entries"), store.read("state"), store.read("pins"), 7, 9, cursor=timeline.Cursor(1705500000, 500))
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = plan_of(df)
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(feed_id,9)" in plan and "LessThanOrEqual(published_at,1705500000)" in plan


def test_seen_list_without_a_limit_keeps_every_url(rows):
    n = listing.MAX_SEEN + 500
    seen = rows("source string, url string, seq bigint", [("s", f"u{i}", i) for i in range(n)])
    none = "source string, url string"
    cand = rows(f"{none}, pos bigint", [("s", "new", 70_000), ("s", "u1", 3)])

    def folded(**limit):
        parts = rows(f"{none}, n bigint", []), cand, cand, rows(none, []), rows("source string", [])
        return {r.url: r.seq for r in listing.commit_state(seen, *parts, **limit).seen.collect()}

    assert len(folded()) == listing.MAX_SEEN
    assert folded(max_seen=None) == {f"u{i}": i for i in range(n)} | {"new": n}


def test_fan_out_carries_marks_in_cells_and_never_exchanges_the_product(rows, monkeypatch):
    monkeypatch.setattr(fanout, "USERS_PER_CELL", 2)
    schema = "id bigint, feed_id bigint, title string, body string, published_at bigint, created_at bigint, first bigint"
    entries = rows(schema, [(i, i % 2, f"t{i}", "spam" if i == 3 else "x", i, i, 9 if i == 4 else None) for i in range(6)])
    subs = rows("user_id bigint, feed_id bigint", [(u, f) for u in range(9) for f in (0, 1) if u or f])
    words = rows("user_id bigint, word string", [(5, "SPAM"), (0, "spam"), (7, "none")])
    reads = rows("user_id bigint, entry_id bigint, read_at bigint", [(1, 4, 7), (8, 1, 8), (0, 2, 6)])
    out = fanout.fan_out(entries, subs, words, "first", reads)
    want = {
        (u, e, e % 2, e, e, {(1, 4): 7, (8, 1): 8}.get((u, e), 9 if e == 4 else None), int((u, e) in ((5, 3), (0, 3))))
        for u in range(9) for e in range(6) if u or e % 2
    }
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(map(repr, want))
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and not [line for line in joins if " = user_id#" in line and " = entry_id#" in line]


def test_state_of_pairs_is_the_state_of_those_pairs_without_the_product(spark):
    fx = Fixtures(spark, SF_DIR)
    pairs = fx.raw("events").selectExpr("user_id", "event_id % 40 AS entry_id").distinct()
    found = fx.state_of(pairs)
    want = fx.state({"asked": pairs.withColumn("value", F.lit(1))}).filter("asked = 1").drop("asked")
    assert found.count() and found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()
    assert "_cells" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_unread_state_is_combined_before_it_meets_the_entries(rows):
    entries = rows("id bigint, feed_id bigint, fetched_at bigint", [(1, 1, 5), (2, 1, 5), (3, 1, 50)])
    state = rows("entry_id bigint, user_id bigint, read_at bigint", [(1, u, None) for u in range(5)] + [(2, 1, 9)])
    gone = retention.expired_entries(entries, state, rows("entry_id bigint", []), 10)
    assert [r.id for r in gone.collect()] == [2]
    assert "Aggregate" in gone._jdf.queryExecution().optimizedPlan().toString()
