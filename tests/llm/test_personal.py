from __future__ import annotations

import itertools
import time

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import pii_crf
from skein.llm.queries import op1_skip_chain_crf

SF_DIR = f"{brute.TESTDATA}/sf0.001"
PARTS = ["a.b", "@", "x-y.org", "+1 ", "(555) ", "1.2", ".3.4", "256", "4387513035237269", "-", " ", "é", "9" * 5, "z", ".", "+"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14))
def test_base_spans_equal_the_plain_patterns(parts):
    text = "".join(parts)
    assert pii_crf.base_spans(text) == brute.personal(text)


def test_hostile_runs_stay_linear():
    for text in ("a" * 300_000, "a@" * 100_000, "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "1 2-" * 75_000):
        pii_crf.base_spans(text)
    assert pii_crf.base_spans("1." * 4 + "x") == brute.personal("1." * 4 + "x")


def exact(unary, links, potentials):
    n, labels = unary.shape
    share = np.zeros((n, labels))
    for state in itertools.product(range(labels), repeat=n):
        score = sum(unary[i, s] for i, s in enumerate(state))
        score += sum(p[state[a], state[b]] for (a, b), p in zip(links, potentials, strict=True))
        for i, s in enumerate(state):
            share[i, s] += np.exp(score)
    return share / share.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("seed", range(5))
def test_messages_are_exact_on_trees_and_near_on_loops(seed):
    draw = np.random.default_rng(seed)
    unary = draw.normal(size=(5, 3))
    tree = np.array([(0, 1), (1, 2), (1, 3), (3, 4)])
    potentials = draw.normal(size=(5, 3, 3)) * 0.7
    assert np.allclose(pii_crf.beliefs(unary, tree, potentials[:4], 60), exact(unary, tree, potentials[:4]), atol=1e-4)
    loop = np.concatenate([tree, [(0, 4)]])
    assert np.abs(pii_crf.beliefs(unary, loop, potentials, 80) - exact(unary, loop, potentials)).max() < 0.15


def test_repeated_forms_get_one_label(spark):
    model = pii_crf.train(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    text = "call +1 (988) 555-2485 now, or later 988-555-2485; order 7731 of 2024. bosbt.42@mail.example.com as bosbt.42"
    found = pii_crf.scan(text, model)
    base = [s for s in found if s[3]]
    added = {(k, text[s:e]) for k, s, e, b in found if not b}
    assert [s[0] for s in base] == ["phone", "email"]
    assert ("phone", "988-555-2485") in added
    assert not any("2024" in t or "7731" in t for _, t in added)
    assert pii_crf.scan("room 12 at 10:30 in 2024", model) == []


def test_the_sample_keeps_all_labels_in_proportion(docs, monkeypatch):
    rows = [(i, " ".join(f"row{k} of" for k in range(100)) + f" from user{i}@mail.example.org") for i in range(250)]
    seen = {}
    monkeypatch.setattr(pii_crf, "fit", lambda features, labels, pairs: seen.update(labels=labels, features=features))
    pii_crf.train(docs([*rows, *rows]))
    labels = seen["labels"]
    assert len(labels) == len(seen["features"]) == pii_crf.SAMPLE_TOKENS
    assert 140 <= (labels == pii_crf.LABELS.index("email")).sum() <= 250


@pytest.fixture(scope="module")
def model(spark):
    return pii_crf.train(spark.read.parquet(f"{SF_DIR}/documents.parquet"))


def test_evidence_reaches_every_repeat(model):
    for n in (1, 3, 100, 1000):
        text = "call +1 (988) 555-2485 now; " + "so 988-555-2485, then; " * n
        found = [text[s:e] for k, s, e, b in pii_crf.scan(text, model) if k == "phone" and not b]
        assert found == ["988-555-2485"] * n
        text = "mail jonasbeck@mail.example.com today; " + "ask jonasbeck about it; " * n
        found = [text[s:e] for k, s, e, b in pii_crf.scan(text, model) if k == "email" and not b]
        assert found == ["jonasbeck"] * n


def test_role_names_stay_words(model):
    text = "ask support@mail.example.com or sales@mail.example.com; our support and sales teams support you"
    assert [s for s in pii_crf.scan(text, model) if not s[3]] == []


def test_hostile_texts_are_linear(model):
    began = time.process_time()
    pii_crf.scan("." * 1_000_000 + " 1", model)
    addresses = " ".join(f"user{i}x@mail.example.com," for i in range(20_000))
    assert len(pii_crf.scan(addresses, model)) == 20_000
    assert time.process_time() - began < 20


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 4)), max_size=8), st.text(alphabet="1.@a +-", max_size=40))
def test_the_walk_finds_the_first_span_over_each(gaps, text):
    spans, at = [], 0
    for gap, size in gaps:
        spans.append((at + gap, at + gap + size))
        at += gap + size
    base = brute.personal(text)
    plain = [next((b for b in base if b[1] < e and s < b[2]), None) for s, e in spans]
    assert list(pii_crf.first_over(spans, base)) == plain


def test_the_field_does_not_need_a_base_span(model):
    text = "write to user@exämple.com about it"
    for shown in (text, text + "; host 10.0.0.1"):
        assert ("email", 9, 25, False) in pii_crf.scan(shown, model)
    assert pii_crf.scan("chapter 3 of 12, pages 100-120, in 1987", model) == []


def test_untrained_model_and_odd_rows(docs, odd_rows, with_clashes):
    assert pii_crf.train(docs([])).weights.tolist() == pii_crf.prior().weights.tolist()
    rows = [*odd_rows, (30, "mail a.b@c.org é 10.0.0.1")]
    model = pii_crf.train(docs(rows))
    df = with_clashes(docs(rows))
    assert pii_crf.find_personal(df, model).count() == len(rows)
    out = pii_crf.mask_personal(df, model)
    assert out.columns == df.columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[30] == "mail [email] é [ip]" and texts[1] is None and texts[2] == ""
    assert pii_crf.mask_personal(docs([]), model).count() == 0


def test_every_document_of_the_table(spark):
    got = {r["doc_id"]: r for r in op1_skip_chain_crf(spark, SF_DIR).collect()}
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        spans = brute.personal(r["text"])
        assert got[r["doc_id"]]["base_sha256"] == brute.sha(brute.digest(spans))
        assert [got[r["doc_id"]][f"n_{k}"] for k in pii_crf.KINDS] == [sum(s[0] == k for s in spans) for k in pii_crf.KINDS]
        assert set(brute.digest(spans).split(",")) - {""} <= set(got[r["doc_id"]]["spans"].split(","))
