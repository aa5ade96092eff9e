from __future__ import annotations

import random
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest

from skein.llm import near_dedup
from skein.llm.queries import op7_prob_minhash_classes

SF_DIR = f"{brute.TESTDATA}/sf0.001"


def bag(text):
    w = brute.words_of(text)
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def similarity(a, b):
    total = 0.0
    for i in a.keys() & b.keys():
        total += 1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in a.keys() | b.keys())
    return total


def fast_similarity(a, b):
    """The exact form, which test_exact_similarity holds against the definition."""
    number = {s: i for i, s in enumerate(sorted(a.keys() | b.keys()))}
    sides = [(np.array([number[s] for s in sorted(c)], np.uint64), np.array([c[s] for s in sorted(c)])) for c in (a, b)]
    return near_dedup.probability_jaccard(*sides[0], *sides[1])


def wanted(rows, similarity=similarity):
    """Classes by comparing all pairs that share a shingle."""
    bags, root = [bag(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders, same = defaultdict(list), defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        same[("text", text) if text is not None else ("null", doc)].append(i)
        for s in bags[i]:
            holders[s].append(i)
    pairs = {(a, b) for own in holders.values() for x, a in enumerate(own) for b in own[x + 1 :]}
    links = [(own[0], i) for own in same.values() for i in own]
    links += [(a, b) for a, b in pairs if similarity(bags[a], bags[b]) >= near_dedup.SIMILARITY - 1e-12]
    for a, b in links:
        root[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        known = [x for x in (least.get(r), doc) if x is not None]
        least[r] = min(known) if known else None
    return sorted(((doc, least[find(i)]) for i, (doc, _) in enumerate(rows)), key=repr)


def got(df):
    return sorted(((r["doc_id"], r["class_id"]) for r in df.collect()), key=repr)


def varied(seed, groups=5, copies=14, words=90):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(words)]
        for _ in range(copies):
            text = list(base)
            for _ in range(draw.randrange(0, 5)):
                text[draw.randrange(words)] = word()
            rows.append((draw.randrange(10_000), " ".join(text)))
    return list({r[0]: r for r in rows}.values())


def test_registers_estimate_probability_jaccard():
    a = Counter({i: 1 + i % 3 for i in range(60)})
    b = Counter({i: 1 + (i * 2) % 5 for i in range(20, 80)})
    m = 4000
    rows = []
    for c in (a, b):
        h = near_dedup.mix(np.array(sorted(c), np.uint64) + np.uint64(1))
        rows.append(near_dedup.prob_minhash(np.zeros(len(c), np.int64), h, np.array([c[k] for k in sorted(c)]), 1, m)[0])
    assert abs((rows[0] == rows[1]).mean() - similarity(a, b)) < 0.03


@pytest.mark.parametrize("seed", range(3))
def test_exact_similarity(seed):
    draw = random.Random(seed)
    a = Counter(draw.randrange(30) for _ in range(60))
    b = Counter(draw.randrange(30) for _ in range(60))
    sides = [(np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)])) for c in (a, b)]
    assert abs(near_dedup.probability_jaccard(*sides[0], *sides[1]) - similarity(a, b)) < 1e-9


def test_batches_do_not_change_registers():
    texts = pa.array(["a b c d e f g", None, "", "one two", "a b c d e f g a b c d e f g"])
    row, h, w = near_dedup.weighted_shingles(texts)
    together = near_dedup.prob_minhash(row, h, w, len(texts), 24)
    for i in range(len(texts)):
        r, hh, ww = near_dedup.weighted_shingles(texts.slice(i, 1))
        assert (near_dedup.prob_minhash(r, hh, ww, 1, 24)[0] == together[i]).all()
    assert near_dedup._text_keys(texts, [1, 2, 3, 4, 5])[3] == near_dedup._text_keys(texts.slice(3, 1), [4])[0]


@pytest.mark.parametrize("seed", range(2))
def test_classes_equal_all_pairs(docs, seed):
    rows = varied(seed)
    assert got(near_dedup.classes(docs(rows))) == wanted(rows)


def test_a_bucket_of_texts_below_the_limit(docs):
    """Texts alike at about 0.6 share many bands; chained copies among them still meet."""
    draw = random.Random(11)
    base = [f"w{draw.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(40):
        text = list(base)
        for at in range(3 + i % 5, 200, 29):
            text[at] = f"x{i}y{at}"
        rows.append((i, " ".join(text)))
        rows.append((100 + i, " ".join(text[:-2] + ["tail", f"t{i}"])))
    assert got(near_dedup.classes(docs(rows))) == wanted(rows, fast_similarity)


def test_texts_below_the_limit_are_not_compared(docs, monkeypatch):
    """Pairs at about 0.7 share bands; the last round's sketches tell them from pairs at the limit."""
    draw = random.Random(5)
    base = [f"w{draw.randrange(10**6)}" for _ in range(230)]
    rows = []
    for i in range(40):
        text = list(base)
        for at in draw.sample(range(230), 4):
            text[at] = f"x{i}y{at}"
        rows.append((i, " ".join(text)))
    rows += [(100 + i, f"{rows[i][1]} one more") for i in range(4)]
    compared, verified = [], near_dedup._verified

    def counted(pairs, texts, similarity):
        compared.append(pairs.count())
        return verified(pairs, texts, similarity)

    monkeypatch.setattr(near_dedup, "STAR_ROUNDS", 0)
    monkeypatch.setattr(near_dedup, "FIRST_BANDS", near_dedup.BANDS)
    monkeypatch.setattr(near_dedup, "_verified", counted)
    assert got(near_dedup.classes(docs(rows))) == wanted(rows, fast_similarity)
    links = sum(fast_similarity(bag(a), bag(b)) >= near_dedup.SIMILARITY for i, (_, a) in enumerate(rows) for _, b in rows[:i])
    assert links <= sum(compared) < 200 < len(rows) * (len(rows) - 1) / 2 / 3


def test_sketches_keep_pairs_at_the_limit():
    m = near_dedup.BANDS * near_dedup.ROWS
    draw = np.random.default_rng(3)
    a = draw.integers(1, 1 << 62, (2000, m), dtype=np.int64).astype(np.uint64)
    b = np.where(draw.random((2000, m)) < near_dedup.SIMILARITY, a, a + np.uint64(1))
    limit = near_dedup.sketch_limit(near_dedup.SIMILARITY, m)

    def differing(x, y):
        unlike = np.unpackbits((near_dedup._sketch(x) ^ near_dedup._sketch(y)).view(np.uint8), axis=1)
        return (unlike[:, :m] | unlike[:, m:]).sum(axis=1)

    assert differing(a, b).max() <= limit < differing(a, b[::-1]).min()


def test_odd_rows(docs, odd_rows, with_clashes):
    df = with_clashes(docs(odd_rows))
    classes = set(got(near_dedup.classes(df.filter("doc_id is not null"))))
    assert {(5, 5), (6, 5), (8, 8), (9, 8), (9, 9), (1, 1), (2, 2)} <= classes
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    ids = sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect())
    assert ids.count(5) == 1 and 6 not in ids and 1 in ids and 2 in ids and 10 in ids
    assert near_dedup.classes(docs([])).count() == 0 and near_dedup.keep_one(docs([])).count() == 0


def test_every_document_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op7_prob_minhash_classes(spark, SF_DIR)) == wanted(rows, fast_similarity)
