"""Aligned page differences, hostile JSON-LD and the order of patches."""

from __future__ import annotations

import random
from collections import Counter
from functools import cache

import pytest
from pyspark.sql import functions as F

from skein.operators import blocks, pagedom, sources

SHAPE = "source bigint, pos bigint, key string, html string, text string"


def plain_alignment(prev, curr):
    """Longest common subsequence by the textbook recursion, walked from the front."""

    @cache
    def longest(i, j):
        if i == len(prev) or j == len(curr):
            return 0
        if prev[i] == curr[j]:
            return 1 + longest(i + 1, j + 1)
        return max(longest(i + 1, j), longest(i, j + 1))

    added, removed, i, j = [], [], 0, 0
    while i < len(prev) or j < len(curr):
        if i < len(prev) and j < len(curr) and prev[i] == curr[j]:
            i, j = i + 1, j + 1
        elif j == len(curr) or (i < len(prev) and longest(i + 1, j) >= longest(i, j + 1)):
            removed.append(i)
            i += 1
        else:
            added.append(j)
            j += 1
    for key in set(prev) | set(curr):
        both = min(sum(curr[x] == key for x in added), sum(prev[x] == key for x in removed))
        for side, keys in ((added, curr), (removed, prev)):
            for at in [x for x in side if keys[x] == key][:both]:
                side.remove(at)
    return added, removed


def pair(rng):
    prev = [rng.choice("abcde") for _ in range(rng.randrange(14))]
    curr = [k for k in prev if rng.random() < 0.7]
    for _ in range(rng.randrange(6)):
        curr.insert(rng.randrange(len(curr) + 1), rng.choice("abcdef"))
    return prev, curr


def test_alignment_equals_the_plain_one():
    rng = random.Random(7)
    for _ in range(1500):
        prev, curr = pair(rng)
        assert blocks.aligned_positions(prev, curr) == plain_alignment(prev, curr)


def test_aligned_rows_of_many_pages(rows):
    rng = random.Random(8)
    pairs = [pair(rng) for _ in range(60)]

    def table(side):
        return rows(SHAPE, [(s, i * 3, k, f"<p>{k}</p>", k) for s, p in enumerate(pairs) for i, k in enumerate(p[side])])

    got = blocks.aligned_diff(table(0), table(1), ["source"]).collect()
    for s, (prev, curr) in enumerate(pairs):
        added, removed = plain_alignment(prev, curr)
        mine = {(r.change, r.pos // 3, r.key) for r in got if r.source == s}
        assert mine == {("added", j, curr[j]) for j in added} | {("removed", i, prev[i]) for i in removed}
        surplus = Counter(curr) - Counter(prev)
        assert Counter(k for c, _, k in mine if c == "added") == surplus
    over = blocks.aligned_diff(table(0), table(1), ["source"], limit=3)
    plain = blocks.block_diff(table(0), table(1), ["source"])
    large = {s for s, p in enumerate(pairs) if max(map(len, p)) > 3}
    assert {tuple(r) for r in over.collect() if r.source in large} == {tuple(r) for r in plain.collect() if r.source in large}


@pytest.mark.parametrize("depth", [10, 900, 200_000])
def test_deep_json_ld_gives_a_row(rows, depth):
    inner = '{"@type":"Article","datePublished":"2024-01-02"}'
    texts = ['{"a":' * depth + inner + "}" * depth, "[" * depth, inner, '{"@type":["x","NewsArticle"],"datePublished":"d"}', '{"@type":{}}', None]
    got = [r[0] for r in rows("i int, t string", list(enumerate(texts))).orderBy("i").select(pagedom.jsonld_date(F.col("t"))).collect()]
    assert got[2] == "2024-01-02" and got[1] is None and got[4] is None and got[5] is None
    assert got[0] == ("2024-01-02" if depth < 1000 else None)


def test_the_last_patch_of_a_field_counts(rows):
    held = rows(
        "id bigint, feed_id bigint, kind string, target_url string, config string, state string, updated_at bigint",
        [(1, 5, "pagewatch", "u", "{}", None, 0)],
    )
    patches = rows(
        "feed_id bigint, seq bigint, config string, target_url string, state string",
        [(5, 2, "a", None, None), (5, 1, "z", "t1", "s"), (5, 3, None, "s0", None)],
    )
    (got,) = sources.patch_sources(held, patches, 9).collect()
    assert (got.config, got.target_url, got.state, got.updated_at) == ("a", "s0", "s", 9)
