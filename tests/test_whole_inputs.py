"""Queries over inputs that the driver tables do not hold: empty texts, pages of many blocks."""

from __future__ import annotations

import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from oracle import TESTDATA, compare

from skein.operators import blocks, pagedom
from skein.plans.fixtures import Fixtures
from skein.plans.registry import load_all
from skein.session import prepare
from skein.sources import dom

SF_DIR = f"{TESTDATA}/sf0.001"


@pytest.fixture
def changed(workdir):
    """A copy of the smallest tables with some replaced by a SELECT, and DuckDB over it."""

    def make(**selects):
        con = duckdb.connect()
        for name in ("documents", "events", "pages", "benchmark"):
            con.execute(f"CREATE VIEW {name}_0 AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
            path = os.path.join(workdir, f"{name}.parquet")
            con.execute(f"COPY ({selects.get(name, f'SELECT * FROM {name}_0')}) TO '{path}' (FORMAT parquet)")
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
        return workdir, con

    return make


def equal(spark, changed_tables, name):
    folder, con = changed_tables
    q = load_all()[name]
    return compare(q.run(Fixtures(prepare(spark), folder)), con, q.sql)


def test_item_identity_of_empty_and_null_texts(spark, changed):
    texts = "CASE WHEN doc_id % 10 = 0 THEN '' WHEN doc_id % 10 = 3 THEN NULL ELSE text END"
    tables = changed(documents=f"SELECT doc_id, {texts} AS text, lang, source, n_chars FROM documents_0")
    ok, note = equal(spark, tables, "item_identity")
    assert ok, note


def table_alignment(prev, curr):
    """The whole table of lengths, walked from the front, moves cancelled."""
    n, m = len(prev), len(curr)
    tails = np.zeros((n + 1, m + 1), int)
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            same = prev[i] == curr[j]
            tails[i, j] = tails[i + 1, j + 1] + 1 if same else max(tails[i + 1, j], tails[i, j + 1])
    added, removed, i, j = [], [], 0, 0
    while i < n and j < m:
        if prev[i] == curr[j]:
            i, j = i + 1, j + 1
        elif tails[i + 1, j] >= tails[i, j + 1]:
            removed.append(i)
            i += 1
        else:
            added.append(j)
            j += 1
    removed += range(i, n)
    added += range(j, m)
    moved = Counter(curr[j] for j in added) & Counter(prev[i] for i in removed)
    for side, keys in ((added, curr), (removed, prev)):
        for key, copies in moved.items():
            for at in [x for x in side if keys[x] == key][:copies]:
                side.remove(at)
    return added, removed


@pytest.mark.parametrize("cells", [1, 7, 40, 1 << 22])
def test_alignment_by_halves_equals_the_whole_table(monkeypatch, cells):
    monkeypatch.setattr(blocks, "ALIGNED_CELLS", cells)
    rng = random.Random(11)
    for _ in range(300):
        prev = [rng.choice("abcdefg") for _ in range(rng.randrange(30))]
        curr = [k for k in prev if rng.random() < 0.8]
        for _ in range(rng.randrange(9)):
            curr.insert(rng.randrange(len(curr) + 1), rng.choice("abcdefgh"))
        assert blocks.aligned_positions(prev, curr) == table_alignment(prev, curr)


def test_long_versions_are_aligned_too(rows):
    body = [f"k{i}" for i in range(2100)]
    sides = [body + ["r"], ["r", *body, "r"]]
    tables = [
        rows("source bigint, pos bigint, key string, html string, text string", [(1, i, k, k, k) for i, k in enumerate(side)])
        for side in sides
    ]
    found = blocks.aligned_diff(*tables, ["source"]).collect()
    assert [(r.change, r.pos, r.key) for r in found] == [("added", 0, "r")]


def test_blocks_of_a_long_page_are_all_there(rows):
    html = "<body>" + "".join(f"<p>Line {i}</p>" for i in range(5200)) + "</body>"
    page = rows("page_id bigint, url string, html string", [(1, "https://a.example.com/", html)])
    found = pagedom.page_blocks(dom.dom_rows(page), page).orderBy("pos").collect()
    assert [r.text for r in found] == [f"Line {i}" for i in range(5200)]
    assert all(r.truncated for r in found)


LONG = """SELECT page_id, url, CASE WHEN page_id IN (3, 5) THEN concat('<html><body>', array_to_string(list_transform(
  range(5100 + page_id), lambda i: concat('<p>Line ', chr(CAST(97 + (i * page_id) % 26 AS INT)), ' of ', i, '</p>')), ''), '</body></html>')
  ELSE html END AS html FROM (SELECT page_id, regexp_replace(url, '//[^/?#]+', CASE WHEN page_id IN (3, 5) THEN '//long.example.com' ELSE '//short.example.com' END) AS url, html FROM pages_0) p"""


@pytest.mark.parametrize("name", ["page_blocks", "content_hash", "full_page_section", "aligned_diff_counts"])
def test_long_pages_equal_their_sql(spark, changed, name):
    ok, note = equal(spark, changed(pages=LONG), name)
    assert ok, note
