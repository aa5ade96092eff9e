from __future__ import annotations

import math

import brute
import numpy as np
import pytest

from skein.llm import impact_index
from skein.llm.queries import op12_impact_ordered_topk

SCHEMA = "vec_id bigint, embedding array<double>, label string"


def plain(rows, asked, k=10):
    """All scores of every query, in integers, sorted."""
    usable = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows]
    out = set()
    for q, v in asked:
        query = [math.floor(1024 * c) for c in v]
        scores = [(-sum(a * b for a, b in zip(query, w)), i) for i, w in usable if i != q]
        out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k])}
    return out


def found(spark, rows, asked, **options):
    index = impact_index.build_index(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", shard_rows=64)
    got = impact_index.search(index, spark.createDataFrame(asked, SCHEMA), "vec_id", "embedding", **options)
    return {tuple(r) for r in got.collect()}


def test_query_equals_all_products(spark):
    path = f"{brute.TESTDATA}/sf0.01"
    table = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = [(r["vec_id"], r["embedding"]) for r in table]
    got = op12_impact_ordered_topk(spark, path)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert {tuple(r) for r in got.collect()} == plain(rows, [r for r in rows if r[0] % 100 == 0])


@pytest.mark.parametrize("seed", range(3))
def test_many_shards_blocks_and_ties(spark, seed):
    rng = np.random.default_rng(seed)
    few = rng.integers(-2, 3, size=(40, 6)) / 4
    vectors = few[rng.integers(0, 40, 600)].tolist()
    rows = [(i, v, "x") for i, v in enumerate(vectors)]
    asked = rows[::25]
    want = plain([r[:2] for r in rows], [r[:2] for r in asked], 7)
    assert found(spark, rows, asked, k=7, block_rows=5) == want


def test_bounds_leave_rows_out_only_by_proof():
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(4000, 32)) * 150).astype(np.int64)
    searcher = impact_index.Searcher(impact_index.build_shard(np.arange(4000), vectors))
    left = []
    for q in range(20):
        exact = vectors @ vectors[q]
        best = set(np.argsort(-exact, kind="stable")[:10].tolist())
        alive = searcher.possible(vectors[q], 10, None, -1)
        assert best <= set(alive.tolist())
        left.append(len(alive))
    assert max(left) <= 1000  # pruned, not merely rescored


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, 0.25], "a"), (2, None, "b"), (3, [0.5, None], "c"), (4, [nan, 1.0], "d"), (5, [inf, 1.0], "e"),
        (None, [1.0, 1.0], "f"), (6, [], "g"), (7, [0.5], "h"), (8, [0.5, 0.25], "i"), (8, [0.5, 0.25], "j"),
        (9, [-1.0, -1.0, 3.0], "k"),
    ]
    usable = [(i, [*v, 0.0, 0.0, 0.0][:3]) for i, v in ((r[0], r[1]) for r in rows) if i in (1, 6, 7, 8, 9)]
    want = plain(usable, usable, 10)
    assert found(spark, rows, rows, k=10) == want
    assert found(spark, rows, []) == set()
    assert found(spark, [], rows) == set()


def test_huge_scores_stop_at_a_long(spark):
    rows = [(1, [4e12, 4e12], "a"), (2, [4e12, 4e12], "b"), (3, [-4e12, 1.0], "c")]
    top = (1 << 63) - 1
    got = found(spark, rows, rows[:1], k=5)
    assert {r[:3] for r in got} == {(1, 1, 2), (1, 2, 3)}
    assert {r[3] for r in got} == {top, -top - 1}
