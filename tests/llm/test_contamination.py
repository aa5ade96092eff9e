from __future__ import annotations

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import decontaminate
from skein.llm.fm_index import FMIndex
from skein.llm.queries import op4_fm_index_decontamination

SF_DIR = f"{brute.TESTDATA}/sf0.001"
ITEMS = "item_id string, text string"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=120), st.integers(1, 4))
def test_index_finds_every_occurrence(values, size):
    text = np.array(values)
    index = FMIndex(text, step=4)
    patterns = np.array([[1 + (i >> (2 * j)) % 4 for j in range(size)] for i in range(4**size)])
    low, high = index.search(patterns)
    for pattern, lo, hi in zip(patterns, low, high, strict=True):
        want = [i for i in range(len(text) - size + 1) if (text[i : i + size] == pattern).all()]
        assert sorted(index.locate(np.arange(lo, max(lo, hi))).tolist()) == want


def facts(found):
    import hashlib

    out = []
    for r in found.collect():
        items = sorted(r["items"])
        hit = sum(x["end"] - x["start"] for x in r["ranges"])
        digest = hashlib.sha256(",".join(items).encode()).hexdigest()
        out.append((r["doc"]["doc_id"], r["n_words"], hit, len(items), digest, hit > 0))
    return sorted(out, key=repr)


def wanted(rows, items):
    items = [("null" if i is None else i, t) for i, t in items]
    return sorted(((r[0], *brute.contamination(r[1], items).values()) for r in rows), key=repr)


LINE = "Alpha beta, GAMMA delta epsilon zeta eta theta iota kappa lambda mu"


def test_windows_short_items_and_boundaries(spark, docs, odd_rows, with_clashes):
    items = [("b", LINE), ("a", "short text"), ("c", "é"), (None, "alpha beta"), ("d", None), ("e", "..."), ("b", LINE)]
    rows = [
        *odd_rows,
        (20, "x alpha beta gamma delta epsilon zeta eta theta iota kappa y"),
        (21, "alpha beta gamma delta epsilon zeta eta theta iota"),
        (22, LINE.upper() + " " + LINE),
        (23, "short"),
        (24, "text"),
        (25, "short-text É é"),
    ]
    bench = spark.createDataFrame(items, ITEMS)
    found = decontaminate.find_contamination(with_clashes(docs(rows)), bench)
    assert facts(found) == wanted(rows, items)
    blocks = decontaminate.find_contamination(docs(rows), bench, block_bytes=20)
    assert facts(blocks) == wanted(rows, items)
    assert decontaminate.find_contamination(docs([]), bench).count() == 0
    assert facts(decontaminate.find_contamination(docs(rows), spark.createDataFrame([], ITEMS))) == wanted(rows, [])


def test_every_document_of_the_table(spark):
    got = {r["doc_id"]: r for r in op4_fm_index_decontamination(spark, SF_DIR).collect()}
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    assert len(got) == len(rows)
    for r in rows:
        want = brute.contamination(r["text"], items)
        assert {k: got[r["doc_id"]][k] for k in want} == want


def test_removed_text_holds_no_window(spark, docs, with_clashes):
    rows = [(1, f"Before it. {LINE} After it."), (2, "clean"), (3, None), (4, f"é {LINE}é {LINE}")]
    df = with_clashes(docs(rows))
    out = decontaminate.remove_contamination(df, spark.createDataFrame([("b", LINE)], ITEMS))
    assert out.columns == df.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[1] == "Before it.   After it." and texts[2] == "clean" and texts[3] is None
    assert all(not brute.contamination(t, [("b", LINE)])["contaminated"] for t in texts.values())


def test_hash_matches_are_compared(monkeypatch):
    block = decontaminate.build_block([("a", "one two")])
    words = decontaminate.find_words(*decontaminate.text_bytes(decontaminate.pa.array(["one six"])))
    forged = words._replace(hashes=np.where(np.arange(2) == 1, block.hashes[::-1][0], words.hashes))
    symbols = decontaminate._symbols(forged, block)
    spelled = {"one", "two"}
    assert (symbols > 0).tolist() == ["one" in spelled, False]


@pytest.mark.parametrize("text", ["", "A", "aÀb"])
def test_words_equal_the_pattern(text):
    words = decontaminate.find_words(*decontaminate.text_bytes(decontaminate.pa.array([text])))
    spelled = [words.lower[s:e].tobytes().decode() for s, e in zip(words.starts, words.ends, strict=True)]
    assert spelled == brute.words_of(text)
