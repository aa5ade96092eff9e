"""Counters, first pages and expiry from marks equal those from the rows of (subscriber, entry)."""

from __future__ import annotations

import random

import pytest
from oracle import TESTDATA

from skein.operators import fanout, unread
from skein.plans.fixtures import Fixtures
from skein.plans.registry import load_all
from skein.session import prepare

WORDS = ["ant", "bee", "cat", "dog", "Eel"]


def world(rng, n_users=25, n_feeds=4, n_entries=120):
    """Entries, subscriptions, words and reads; feed 0 is large, some words match nothing, some reads no feed."""
    entries = [
        (i, 0 if rng.random() < 0.6 else rng.randrange(n_feeds), rng.choice(WORDS), " ".join(rng.choices(WORDS + ["x"] * 9, k=3)), rng.randrange(60) * 40_000)
        for i in range(n_entries)
    ]
    subs = [(u, f) for u in range(n_users) for f in range(n_feeds + 1) if rng.random() < 0.6]
    words = [(u, w) for u in range(0, n_users, 2) for w in rng.sample(["ANT", "bee", "eel", "zz"], rng.randrange(1, 3))]
    reads = {(rng.randrange(n_users + 3), rng.randrange(n_entries + 9)) for _ in range(n_users * 20)}
    return entries, subs, words, sorted(reads)


def rows_of(entries, subs, words, reads):
    hides = {(u, w.lower()) for u, w in words}
    for u, f in subs:
        mine = {w for v, w in hides if v == u}
        for i, feed, title, body, at in entries:
            hidden = any(w in f"{title}\n{body}".lower() for w in mine)
            if feed == f and not hidden and (u, i) not in reads:
                yield u, f, i, at


@pytest.fixture
def tables(spark, rows):
    prepare(spark)

    def make(parts):
        schemas = (
            "id bigint, feed_id bigint, title string, body string, published_at bigint", "user_id bigint, feed_id bigint",
            "user_id bigint, word string", "user_id bigint, entry_id bigint",
        )
        return [rows(s, p) for s, p in zip(schemas, parts, strict=True)]

    return make


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_equal_the_rows(tables, seed):
    parts = world(random.Random(seed))
    entries, subs, words, reads = tables(parts)
    found = unread.unread_counts(entries, subs.selectExpr("*", "0 AS unread_count"), words, reads).collect()
    want = dict.fromkeys(parts[1], 0)
    for u, f, _, _ in rows_of(parts[0], parts[1], parts[2], set(parts[3])):
        want[u, f] += 1
    assert {(r.user_id, r.feed_id): r.unread_count for r in found} == want
    fresh = unread.unread_counts(entries, subs.selectExpr("*", "0 AS unread_count"), words).collect()
    want = dict.fromkeys(parts[1], 0)
    for u, f, _, _ in rows_of(parts[0], parts[1], parts[2], set()):
        want[u, f] += 1
    assert {(r.user_id, r.feed_id): r.unread_count for r in fresh} == want


@pytest.mark.parametrize(("seed", "limit"), [(3, 5), (4, 17), (5, 500)])
def test_newest_rows_hold_every_first_page(tables, monkeypatch, seed, limit):
    monkeypatch.setattr(unread, "RANKS_PER_STEP", 4)
    parts = world(random.Random(seed))
    found = unread.newest_unread(*tables(parts), limit).collect()
    every = list(rows_of(parts[0], parts[1], parts[2], set(parts[3])))
    got = [(r.user_id, r.feed_id, r.entry_id, r.published_at) for r in found]
    assert len(set(got)) == len(got) and set(got) <= set(every)
    for user in {u for u, _ in parts[1]}:
        def page(some, user=user):
            return sorted(((at, i) for u, _, i, at in some if u == user), reverse=True)[:limit]

        assert page(got) == page(every)


def test_unread_by_someone(tables):
    parts = world(random.Random(6), n_users=4)
    entries, subs, _, reads = tables(parts)
    found = {r.entry_id for r in unread.unread_by_someone(entries, subs, reads).collect()}
    assert found == {i for _, _, i, _ in rows_of(parts[0], parts[1], [], set(parts[3]))}


@pytest.mark.parametrize(
    "name",
    ["user_stats", "sidebar_by_rating", "subscription_views", "unread_subscription_views", "upsert_subscriptions", "age_retention",
     "per_feed_cap", "unread_first_pages", "upsert_entries_unread", "mark_ids_read_unread", "recompute_ignored_unread"],
)
def test_no_row_a_subscriber_and_entry(spark, name):
    found = load_all()[name].run(Fixtures(prepare(spark), f"{TESTDATA}/sf0.001"))
    # The fan-out looks a subscriber's marks up by their place in a list.
    assert "array_position" not in found._jdf.queryExecution().executedPlan().toString()


def test_backfill_knows_the_pairs_that_hold_all(tables, rows):
    entries, subs, words, _ = tables(world(random.Random(8)))
    entries = entries.selectExpr("*", "published_at AS created_at")
    asked = subs.unionByName(rows("user_id bigint, feed_id bigint", [(u, 1) for u in range(40)])).distinct()
    state = fanout.fan_out(entries, subs, words)
    want = {tuple(r) for r in fanout.backfill_new_subscribers(entries, asked, words, state).collect()}
    found = fanout.backfill_new_subscribers(entries, asked, words, None, subs).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want) > 0


def test_unsubscribe_makes_only_the_rows_that_stay(spark):
    made = []

    class Asked(Fixtures):
        def state(self, marks=None, entries=None, subs=None):
            made.append(subs)
            return super().state(marks, entries, subs)

    found = load_all()["unsubscribe"].run(Asked(prepare(spark), f"{TESTDATA}/sf0.001"))
    kept = {(r.user_id, r.feed_id) for r in found.filter("kind = 'subscription'").collect()}
    assert {tuple(r) for r in made[-1].collect()} == kept
