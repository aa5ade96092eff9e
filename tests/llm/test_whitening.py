from __future__ import annotations

import math
from fractions import Fraction

import brute
import numpy as np
import pytest

from skein.llm import whitening
from skein.llm.queries import op13_exact_polynomial_whitening

SCHEMA = "vec_id bigint, embedding array<double>, w string"


def check(got, rows, components=8):
    """Rows against a float eigensolver and exact integer sums."""
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows], object)
    n, sums = len(x), x.sum(axis=0)
    centred = (x - np.array([Fraction(int(s), n) for s in sums])).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-6 * values[0]).sum()))
    assert len(got) == n * k
    by = {(r["vec_id"], r["component"]): r for r in got}
    white = np.array([[by[i, c + 1]["whitened"] for c in range(k)] for i, _ in rows])
    for c in range(k):
        expected = centred @ vectors[:, c] / math.sqrt(values[c])
        sign = 1 if white[:, c] @ expected > 0 else -1
        assert np.abs(sign * white[:, c] - expected).max() < 1e-6
        assert by[rows[0][0], c + 1]["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9)
    error = np.abs(white.T @ white / n - np.outer(white.mean(0), white.mean(0)) - np.eye(k)).max()
    for (i, _), dev in zip(rows, ((n * x - sums) ** 2).sum(axis=1), strict=True):
        assert by[i, 1]["deviation"] == dev and by[i, 1]["n"] == n
        assert abs(by[i, 1]["identity_error"] - error) < 1e-9 and error < 1e-9


def test_query_equals_a_float_solver(spark):
    path = f"{brute.TESTDATA}/sf0.001"
    table = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()
    check(op13_exact_polynomial_whitening(spark, path).collect(), [(r["vec_id"], r["embedding"]) for r in table])


def test_polynomial_is_exact(spark):
    scatter = [[6, 2, 0, 1], [2, 5, 1, 0], [0, 1, 4, 1], [1, 0, 1, 9]]
    got = whitening.characteristic_polynomial(spark, scatter)
    for x in range(-3, 12):
        m = [[Fraction(x * (i == j) - scatter[i][j]) for j in range(4)] for i in range(4)]
        det = Fraction(1)
        for c in range(4):
            pivot = next((r for r in range(c, 4) if m[r][c]), None)
            if pivot is None:
                det = Fraction(0)
                break
            if pivot != c:
                m[c], m[pivot], det = m[pivot], m[c], -det
            det *= m[c][c]
            for r in range(c + 1, 4):
                f = m[r][c] / m[c][c]
                m[r] = [a - f * b for a, b in zip(m[r], m[c], strict=True)]
        assert sum(c * x**e for e, c in enumerate(got)) == det


def test_root_counts_and_multiplicities():
    # (x - 5)^2 (x - 2) x
    poly = [0, -50, 45, -12, 1]
    assert [whitening.roots_above(poly, a) for a in (-1, 0, 1, 2, 4, 5)] == [4, 3, 3, 2, 2, 0]
    roots = whitening.greatest_roots(poly, 8)
    assert [(round(float(r), 9), m) for r, m in roots] == [(5.0, 2), (2.0, 1)]


def test_equal_eigenvalues_get_orthogonal_vectors(spark):
    axes = [[1.0, 0, 0], [-1.0, 0, 0], [0, 1.0, 0], [0, -1.0, 0], [0, 0, 3.0], [0, 0, -3.0]]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(axes)]
    got = whitening.whiten(spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA), "vec_id", "embedding").collect()
    assert len(got) == 18 and got[0]["identity_error"] < 1e-9


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=4).tolist()) for i in range(30)]
    bad = [
        (50, None), (51, [1.0, None, 0.0, 0.0]), (52, [float("nan"), 0.0, 0.0, 0.0]), (53, [float("inf"), 0.0, 0.0, 0.0]),
        (54, [1.0, 2.0]), (55, []), (56, [1e30, 0.0, 0.0, 0.0]),
    ]
    table = spark.createDataFrame([(i, v, "x") for i, v in good + bad], SCHEMA)
    check(whitening.whiten(table, "vec_id", "embedding").withColumnRenamed("id", "vec_id").collect(), good)
    for rows in ([], [(1, [1.0, 2.0], "x")], [(1, [1.0, 2.0], "x")] * 3, [(1, [], "x")], [(1, None, "x")]):
        assert whitening.whiten(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding").count() == 0
