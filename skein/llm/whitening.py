"""Embedding whitening by the exact characteristic polynomial of the scatter.

Components become integers, ``floor(scale * c)``; whitening does not change
under the offset of the result contract.  With n rows and sums S, the integer
scatter ``n * sum(x x^T) - S S^T`` is n^2 times the covariance; tasks return
partial sums and Spark adds them as decimals.  Then, all on a table of
width x width numbers however many rows there are:

1. For each of as many 31-bit primes as the coefficients need, a task brings
   the scatter to Hessenberg form modulo the prime and reads the
   characteristic polynomial off it; Chinese remaindering gives the integer
   polynomial.
2. All roots of that polynomial are real, so by Descartes' rule the sign
   changes of the polynomial shifted by a are exactly the number of roots
   above a.  Bisection on those counts isolates the greatest roots, bisection
   on the sign narrows each to ``2 ** -ROOT_BITS`` in integer arithmetic.
3. Null-space inverse iteration in ``DIGITS``-digit decimals gives the unit
   vectors, a task for each distinct root; equal roots share a task, which
   keeps their vectors orthogonal.

A last pass projects the centred rows, and one more aggregates the covariance
of the result.  Components with eigenvalue 0 cannot be whitened and are left
out, so a table of one row, or of equal rows, gives no rows.

Rows with a null vector, null or non-finite entries, entries of 2**42 or more
in size (their squares would not add up exactly), or with fewer entries than
the widest row take no part.  A null id is kept.  Repeated rows count each and
are returned each.  An empty table gives an empty one; other columns are not
looked at.  ``deviation`` is null where it is beyond a long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Context, Decimal
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import map_batches

COMPONENTS = 8
ROOT_BITS = 64
DIGITS = 90
LIMIT = float(1 << 42)


class Moments(NamedTuple):
    n: int
    sums: list[int]
    scatter: list[list[int]]  # n * sum(x x^T) - S S^T


def _fit_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    found = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LIMIT))
    return found.filter(F.col("vector").isNotNull() & ~bad)


def _integers(column: pa.ListArray, scale: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat * float(scale)).astype(np.int64).reshape(len(column), -1)


def moments(rows: DataFrame, width: int, scale: int) -> Moments:
    """Exact sums over all rows; a task sends width * (width + 3) / 2 + 1 numbers."""
    at_i, at_j = np.tril_indices(width + 1)  # row ``width`` stands for a column of ones

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = np.column_stack([_integers(batch.column("vector"), scale), np.ones(batch.num_rows, np.int64)])
            top = int(np.abs(x).max())
            if top * top * len(x) < 1 << 53:
                product = (x.T.astype(np.float64) @ x.astype(np.float64)).astype(np.int64).astype(object)
            else:
                product = x.T.astype(object) @ x.astype(object)
            total = product if total is None else total + product
        if total is not None:
            values = [Decimal(int(v)) for v in total[at_i, at_j]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(at_i.astype(np.int32)),
                    pa.array(at_j.astype(np.int32)),
                    pa.array(values, pa.decimal128(38, 0)),
                ],
                ["i", "j", "s"],
            )

    partial = map_batches(rows.select("vector"), run, "i int, j int, s decimal(38,0)")
    full = [[0] * (width + 1) for _ in range(width + 1)]
    for i, j, s in partial.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        full[i][j] = full[j][i] = int(s)
    n, sums = full[width][width], full[width][:width]
    return Moments(n, sums, [[n * full[i][j] - sums[i] * sums[j] for j in range(width)] for i in range(width)])


def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide all numbers below 2**32."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 7, 61):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes below 2**31, greatest first, whose product is over ``bound``."""
    found, product, n = [], 1, (1 << 31) - 1
    while product <= bound:
        if _is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients (constant first) of det(x I - matrix) modulo ``p`` by its Hessenberg form."""
    h, n = matrix % p, len(matrix)
    for k in range(n - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        u = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - u[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * u % p).sum(axis=1)) % p
    # polys[m]: of the leading m x m block.
    polys = np.zeros((n + 1, n + 1), np.int64)
    polys[0, 0] = 1
    for m in range(1, n + 1):
        nxt = np.zeros(n + 1, np.int64)
        nxt[1:] = polys[m - 1, :-1]
        factors = np.zeros(m, np.int64)
        chain = 1
        factors[m - 1] = h[m - 1, m - 1]
        for i in range(m - 2, -1, -1):
            chain = chain * int(h[i + 1, i]) % p
            factors[i] = int(h[i, m - 1]) * chain % p
        polys[m] = (nxt - (factors[:, None] * polys[:m] % p).sum(axis=0)) % p
    return polys[n]


def characteristic_polynomial(spark: SparkSession, scatter: list[list[int]]) -> list[int]:
    """Integer coefficients, constant first, of det(x I - scatter) for a scatter matrix.

    The eigenvalues are not negative, so the m-th coefficient is at most
    C(width, m) * (trace / width) ** m in size, which sets the number of primes.
    """
    n = len(scatter)
    trace = sum(scatter[i][i] for i in range(n))
    bound = max(math.comb(n, m) * trace**m // n**m + 1 for m in range(n + 1))
    primes = primes_beyond(2 * bound)
    shared = spark.sparkContext.broadcast(np.array(scatter, object))
    slices = min(len(primes), spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            used = batch.column("p").to_pylist()
            found = [polynomial_modulo((shared.value % p).astype(np.int64), p).tolist() for p in used]
            yield pa.RecordBatch.from_arrays(
                [batch.column("p"), pa.array(found, pa.list_(pa.int64()))], ["p", "coefficients"]
            )

    table = spark.createDataFrame([(p,) for p in primes], "p bigint").repartition(slices, "p")
    value, modulus = [0] * (n + 1), 1
    for p, residues in map_batches(table, run, "p bigint, coefficients array<bigint>").collect():
        inverse = pow(modulus, -1, p)
        value = [v + modulus * ((r - v) * inverse % p) for v, r in zip(value, residues, strict=True)]
        modulus *= p
    return [v - modulus if v > modulus // 2 else v for v in value]


def roots_above(coefficients: list[int], a: int) -> int:
    """How many roots (with multiplicity) of an all-real-rooted polynomial are over ``a``: Descartes, exactly."""
    shifted = list(coefficients)
    if a:
        for done in range(len(shifted) - 1):
            for m in range(len(shifted) - 2, done - 1, -1):
                shifted[m] += a * shifted[m + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def _value_sign(coefficients: list[int], a: int) -> int:
    value = 0
    for c in reversed(coefficients):
        value = value * a + c
    return (value > 0) - (value < 0)


def greatest_roots(coefficients: list[int], wanted: int, bits: int = ROOT_BITS) -> list[tuple[Fraction, int]]:
    """(root, multiplicity) of at least ``wanted`` greatest positive roots, falling, each to ``2 ** -bits``.

    Roots closer than that are one root of their joint multiplicity.
    """
    degree = len(coefficients) - 1
    scaled = [c << (bits * (degree - m)) for m, c in enumerate(coefficients)]
    positive = degree - next((m for m, c in enumerate(coefficients) if c), degree)
    wanted = min(wanted, positive)
    top = max(1, -scaled[degree - 1]) if degree else 1  # the trace is over every root
    # Intervals (low, high], greatest first, with the counts of roots over each end.
    open_, found, have = [(0, top, positive, 0)], [], 0
    while have < wanted:
        low, high, over_low, over_high = open_.pop()
        if over_low == over_high:
            continue
        if over_low - over_high == 1 or high - low == 1:
            root = _narrowed(scaled, low, high) if over_low - over_high == 1 else high
            found.append((Fraction(2 * root - 1, 2 << bits), over_low - over_high))
            have += over_low - over_high
            continue
        middle = (low + high) // 2
        over = roots_above(scaled, middle)
        open_ += [(low, middle, over_low, over), (middle, high, over, over_high)]
    return found


def _narrowed(scaled: list[int], low: int, high: int) -> int:
    """The least integer at or over the one root in (low, high]."""
    above = _value_sign(scaled, high)
    if above == 0:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        sign = _value_sign(scaled, middle)
        if sign == 0:
            return middle
        low, high = (low, middle) if sign == above else (middle, high)
    return high


def null_space(scatter: list[list[int]], root: Fraction, many: int, digits: int = DIGITS) -> list[list[float]]:
    """``many`` orthogonal unit vectors of the eigenvalue next to ``root``, by inverse iteration."""
    ctx = Context(prec=digits)
    n = len(scatter)
    at = ctx.divide(Decimal(root.numerator), Decimal(root.denominator))
    rows = [[Decimal(v) for v in row] for row in scatter]
    for i in range(n):
        rows[i][i] = ctx.subtract(rows[i][i], at)
    size = max((abs(v) for row in rows for v in row), default=Decimal(1)) or Decimal(1)
    tiny = ctx.multiply(size, Decimal(10) ** (6 - digits))
    order = list(range(n))
    for k in range(n):
        best = max(range(k, n), key=lambda r: abs(rows[r][k]))
        rows[k], rows[best] = rows[best], rows[k]
        order[k], order[best] = order[best], order[k]
        if abs(rows[k][k]) < tiny:
            rows[k][k] = tiny
        head = rows[k]
        for r in range(k + 1, n):
            row = rows[r]
            if row[k]:
                row[k] = f = ctx.divide(row[k], head[k])
                minus = -f
                for c in range(k + 1, n):
                    row[c] = ctx.fma(minus, head[c], row[c])
    found: list[list[Decimal]] = []
    for which in range(many):
        # Any start with a part in the null space will do; these differ in every entry.
        vector = [Decimal(1 + (which + 2) * (i + 1) ** 2 % (97 + which)) for i in range(n)]
        for _ in range(4):
            y = [vector[order[i]] for i in range(n)]
            for i in range(n):
                for j in range(i):
                    y[i] = ctx.fma(-rows[i][j], y[j], y[i])
            for i in range(n - 1, -1, -1):
                for j in range(i + 1, n):
                    y[i] = ctx.fma(-rows[i][j], y[j], y[i])
                y[i] = ctx.divide(y[i], rows[i][i])
            vector = _unit(ctx, y)
            for other in found + found:
                dot = _dot(ctx, vector, other)
                vector = [ctx.fma(-dot, o, v) for v, o in zip(vector, other, strict=True)]
            vector = _unit(ctx, vector)
        found.append(vector)
    return [[float(v) for v in vector] for vector in found]


def _dot(ctx: Context, a: list[Decimal], b: list[Decimal]) -> Decimal:
    total = Decimal(0)
    for x, y in zip(a, b, strict=True):
        total = ctx.fma(x, y, total)
    return total


def _unit(ctx: Context, vector: list[Decimal]) -> list[Decimal]:
    size = ctx.sqrt(_dot(ctx, vector, vector))
    return [ctx.divide(v, size) for v in vector]


class Fit(NamedTuple):
    """A fitted whitening: eigenvalues of the covariance of the integers, falling, and unit vectors."""

    n: int
    sums: list[int]
    values: list[float]
    shares: list[float]
    vectors: list[list[float]]


def fit(rows: DataFrame, width: int, components: int = COMPONENTS, scale: int = 1024) -> Fit:
    spark = rows.sparkSession
    found = moments(rows, width, scale)
    roots = greatest_roots(characteristic_polynomial(spark, found.scatter), components)
    shared = spark.sparkContext.broadcast(found.scatter)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [
                null_space(shared.value, Fraction(int(r["above"]), int(r["below"])), r["many"])
                for r in batch.to_pylist()
            ]
            kind = pa.list_(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("at"), pa.array(vectors, kind)], ["at", "vectors"])

    listed = [(i, str(r.numerator), str(r.denominator), many) for i, (r, many) in enumerate(roots)]
    vectors: list[list[float]] = []
    if listed:
        table = spark.createDataFrame(listed, "at int, above string, below string, many int")
        spaces = map_batches(table.repartition(len(listed), "at"), run, "at int, vectors array<array<double>>")
        for row in sorted(spaces.collect(), key=lambda r: r["at"]):
            vectors += row["vectors"]
    trace = sum(found.scatter[i][i] for i in range(width))
    values = [r for r, many in roots for _ in range(many)][:components]
    return Fit(
        found.n,
        found.sums,
        [float(r / found.n**2) for r in values],
        [float(r / trace) for r in values],
        vectors[:components],
    )


def _projected(rows: DataFrame, model: Fit, scale: int) -> DataFrame:
    """id, deviation, w (whitened components) of every row."""
    n, sums = model.n, np.array(model.sums, object)
    basis = np.array(model.vectors).T / np.sqrt(np.array(model.values))[None, :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _integers(batch.column("vector"), scale)
            reach = n * int(np.abs(x).max()) + max(abs(int(s)) for s in sums)
            if reach * reach * len(sums) < 1 << 63:
                centred = n * x - sums.astype(np.int64)
                deviation = (centred * centred).sum(axis=1).tolist()
            else:
                centred = n * x.astype(object) - sums
                deviation = [int(d) if d < 1 << 63 else None for d in (centred * centred).sum(axis=1)]
            white = (centred.astype(np.float64) / n) @ basis
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(deviation, pa.int64()), pa.array(white.tolist(), kind)],
                ["id", "deviation", "w"],
            )

    id_type = dict(rows.dtypes)["id"]
    return map_batches(rows, run, f"id {id_type}, deviation bigint, w array<double>")


def whiten(
    vectors: DataFrame, id_col: str, vector_col: str, components: int = COMPONENTS, scale: int = 1024
) -> DataFrame:
    """One row a vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    rows = _fit_rows(vectors, id_col, vector_col)
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    rows = rows.filter(F.size("vector") == width)
    model = fit(rows, width, components, scale) if width else None
    if not model or not model.values:
        id_type = dict(rows.dtypes)["id"]
        return spark.createDataFrame(
            [],
            f"id {id_type}, component int, n bigint, deviation bigint, whitened double, explained double,"
            " identity_error double",
        )
    white = _projected(rows, model, scale)
    k = len(model.values)
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    spread = white.select(*[F.col("w")[i].alias(f"w{i}") for i in range(k)])
    covariance = spread.agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(covariance, pairs, strict=True))
    shares = F.array(*[F.lit(s) for s in model.shares])
    return white.select("id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        shares[F.col("at")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )
