from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import suffix_dedup
from skein.llm.queries import op6_suffix_sort_dedup

SF_DIR = f"{brute.TESTDATA}/sf0.001"


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=200).map(lambda b: bytes(x % 2 for x in b)), st.integers(1, 12))
def test_merge_sort_orders_suffixes(raw, limit):
    data = np.frombuffer(raw + b"\x00" * limit, np.uint8)
    starts = np.arange(len(raw))
    group = starts // 37
    prefix = suffix_dedup.prefix_hashes(data)
    order = suffix_dedup.suffix_merge_sort(data, prefix, starts, group, limit)
    want = sorted(starts, key=lambda i: (group[i], data[i : i + limit].tobytes(), i))
    assert order.tolist() == want


def test_forged_equal_hashes_are_found_out(monkeypatch):
    data = np.frombuffer(b"abcdefgh", np.uint8)
    monkeypatch.setattr(suffix_dedup, "span_hashes", lambda p, s, e: np.zeros(len(s), np.uint64))
    least = suffix_dedup.window_minimum(data, np.array([0, 4]), np.array([0, 0]), np.array([7, 3]), 4)
    assert least.tolist() == [7, 3]


def facts(df):
    import hashlib

    out = []
    for r in df.collect():
        gone = sum(x["end"] - x["start"] for x in r["removed"])
        out.append((r["doc_id"], r["n_bytes"], gone, len(r["removed"]), hashlib.sha256(bytes(r["kept"])).hexdigest()))
    return sorted(out, key=repr)


def wanted(rows):
    last = (1 << 63) - 1
    back = brute.repeats([(last if d is None else d, t) for d, t in rows])
    return sorted(((None if r[0] == last else r[0], *r[1:]) for r in back), key=repr)


def edited(seed, n=24):
    draw = random.Random(seed)
    base = ["".join(draw.choice("abcdé ") for _ in range(draw.randrange(20, 160))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [draw.choice(base) for _ in range(4)]
        text = "".join(p if draw.random() < 0.6 else p[: draw.randrange(len(p))] + "#" + p for p in parts)
        rows.append((draw.randrange(12), text))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_edited_passages_equal_brute_force(docs, seed):
    rows = edited(seed)
    assert facts(suffix_dedup.remove_repeats(docs(rows))) == wanted(rows)


def test_periodic_texts_and_exact_sizes(docs):
    rows = [(3, "ab" * 200), (1, "ab" * 60), (2, "x" * 300), (4, "x" * 50), (5, "x" * 49), (6, "y" + "x" * 49)]
    rows += [(7, "q" * 10 + "0123456789" * 5), (8, "0123456789" * 5 + "z"), (9, "z" + "0123456789" * 5)]
    assert facts(suffix_dedup.remove_repeats(docs(rows))) == wanted(rows)


def test_odd_rows(docs, odd_rows, with_clashes):
    rows = [(d, t if t is None else t[:4000]) for d, t in odd_rows]
    assert facts(suffix_dedup.remove_repeats(with_clashes(docs(rows)))) == wanted(rows)
    assert suffix_dedup.remove_repeats(docs([])).count() == 0


def test_every_document_of_the_table(spark):
    got = sorted(tuple(r) for r in op6_suffix_sort_dedup(spark, SF_DIR).collect())
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    assert got == brute.repeats([tuple(r) for r in rows])


def test_only_windows_that_share_a_hash_are_sorted(monkeypatch):
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    starts, group = np.sort(rng.integers(0, 3980, 900)), np.repeat(np.arange(30), 30)
    value = rng.integers(0, 1000, 900)
    met = []
    sort = suffix_dedup.suffix_merge_sort

    def counted(data, prefix, suffix, group, limit):
        met.append(len(suffix))
        return sort(data, prefix, suffix, group, limit)

    monkeypatch.setattr(suffix_dedup, "suffix_merge_sort", counted)
    least = suffix_dedup.window_minimum(data, starts, group, value, 8)
    keys = [(g, data[s : s + 8].tobytes()) for g, s in zip(group.tolist(), starts.tolist(), strict=True)]
    held = [k for k in keys if keys.count(k) > 1]
    assert least.tolist() == [min(v for k, v in zip(keys, value.tolist(), strict=True) if k == own) for own in keys]
    assert met == [len(held)] and 0 < len(held) < 900
