from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm.queries import op11_suffix_automaton_runs
from skein.llm.run_detection import Run, candidate_stretches, find_runs, runs_of


def plain_runs(words, least=24, periods=3):
    """Every maximal stretch by comparing each word with the one a period before."""
    n, found = len(words), []
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, periods * q):
                part = words[i : j + q]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    found.append(Run(i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r.start, r.period))


def by_automaton(words, least=24, periods=3):
    codes = np.array(words, np.int64)
    found = []
    for s, e in candidate_stretches(codes, np.array([0, len(codes)]), least, periods):
        found += [r._replace(start=r.start + s) for r in runs_of(words[s:e], least, periods)]
    return sorted(found, key=lambda r: (r.start, r.period))


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for r in runs for i in range(r.start + r.period, r.start + r.length)}
    best = max(runs, key=lambda r: (Fraction(r.length, r.period), -r.start, -r.period), default=None)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (
        len(runs),
        *(best or (None, None, None)),
        1000 * best.length // best.period if best else None,
        brute.sha("".join(f"{r.start},{r.length},{r.period}\n" for r in runs)),
        hashlib.sha256(kept).hexdigest(),
    )


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 2, 3, 9]), st.sampled_from([(24, 3), (6, 3), (4, 2), (3, 3)]))
def test_runs_equal_the_plain_search(seed, letters, limits):
    rng = random.Random(seed)
    words = [rng.randrange(letters) for _ in range(rng.randrange(130))]
    for _ in range(rng.randrange(4)):
        if words:
            a, p = rng.randrange(len(words)), rng.randint(1, 12)
            for i in range(a, min(len(words), a + rng.randint(10, 60))):
                words[i] = words[a + (i - a) % p]
    assert runs_of(words, *limits) == plain_runs(words, *limits)
    assert by_automaton(words, *limits) == plain_runs(words, *limits)


def test_fibonacci_words_have_all_their_runs():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert runs_of(b, 2, 2) == plain_runs(b, 2, 2)


def test_long_uniform_text_is_one_run():
    assert runs_of([7] * 200_000) == [Run(0, 200_000, 1)]


def test_query_equals_the_contract(spark):
    path = f"{brute.TESTDATA}/sf0.001"
    got = {r["doc_id"]: tuple(r)[1:] for r in op11_suffix_automaton_runs(spark, path).collect()}
    rows = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in rows if len((r["text"] or "").split()) < 3000]
    assert len(got) == len(rows)
    assert sum(got[r["doc_id"]][0] > 0 for r in short) > 3
    for r in short:
        assert got[r["doc_id"]] == expected(r["doc_id"], r["text"])


@pytest.mark.parametrize("planted", [True, False])
def test_odd_rows(docs, odd_rows, with_clashes, planted):
    rows = [*odd_rows, (77, "a b " * 40), (77, "a b " * 40)]
    got = find_runs(with_clashes(docs(rows)), planted=planted).collect()
    assert len(got) == len(rows)
    twice = [r for r in got if r["doc_id"] == 77]
    assert twice[0] == twice[1] and (planted or tuple(twice[0]["runs"][0]) == (0, 80, 2))
    assert all(r["n_words"] == 0 and r["runs"] == [] for r in got if r["doc_id"] in (1, 2, 3))
    assert find_runs(docs([])).count() == 0
