"""Ranking and running totals that survive a hot key.

A plain ``Window.partitionBy(key)`` sends every row of one key to one task.
When a single feed, user or source can hold a third of the data that task
never finishes.  The helpers here split each key into ordered *slices*, do the
window inside a slice, and add an offset computed from the per-slice totals,
which are pre-aggregated map-side and therefore tiny.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    spread: Column,
    salts: int = 64,
    rank_col: str = "rn",
) -> DataFrame:
    """Exact first ``n`` rows of every key, in two limited window passes.

    ``spread`` is any well-distributed column expression.  Each of the
    ``salts`` slices of a key keeps its own first ``n`` (Spark also applies a
    map-side group limit), so the final pass sees at most ``salts * n`` rows
    of a key however large that key is.
    """
    salt = F.pmod(F.xxhash64(spread), F.lit(salts))
    sliced = (
        df.withColumn("_salt", salt)
        .withColumn("_rs", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order)))
        .filter(F.col("_rs") <= n)
    )
    return (
        sliced.withColumn(rank_col, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        .filter(F.col(rank_col) <= n)
        .drop("_salt", "_rs")
    )


def _slice_offsets(
    df: DataFrame,
    keys: Sequence[str],
    slice_cols: Sequence[str],
    slice_order: Sequence[Column],
    total: Column,
) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy(*slice_order).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, *slice_cols).agg(total.alias("_total"))
    return totals.select(
        *keys, *slice_cols, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset")
    )


def _join_offsets(
    df: DataFrame, offsets: DataFrame, keys: Sequence[str], slice_cols: Sequence[str]
) -> DataFrame:
    names = [*keys, *slice_cols]
    renamed = offsets.select(*[F.col(c).alias(f"_o_{c}") for c in names], "_offset")
    condition = None
    for c in names:
        part = df[c].eqNullSafe(renamed[f"_o_{c}"])
        condition = part if condition is None else condition & part
    return df.join(renamed, condition).drop(*[f"_o_{c}" for c in names])


def sliced_rank(
    df: DataFrame,
    keys: Sequence[str],
    slice_cols: Sequence[str],
    slice_order: Sequence[Column],
    fine_order: Sequence[Column],
    out: str,
) -> DataFrame:
    """``row_number`` over ``keys`` ordered by ``slice_order`` then ``fine_order``.

    ``slice_cols`` must be the columns that ``slice_order`` sorts by, so that
    slices of one key never interleave.
    """
    offsets = _slice_offsets(df, keys, slice_cols, slice_order, F.count(F.lit(1)))
    inner = Window.partitionBy(*keys, *slice_cols).orderBy(*fine_order)
    joined = _join_offsets(df, offsets, keys, slice_cols)
    return joined.withColumn(out, F.row_number().over(inner) + F.col("_offset")).drop("_offset")


def sliced_running_count(
    df: DataFrame,
    keys: Sequence[str],
    slice_col: str,
    fine_order: Sequence[Column],
    out: str,
) -> DataFrame:
    """How many earlier rows of the same key there are (0 for the first)."""
    ranked = sliced_rank(df, keys, [slice_col], [F.col(slice_col).asc()], fine_order, out)
    return ranked.withColumn(out, F.col(out) - 1)


def sliced_last_value(
    df: DataFrame,
    keys: Sequence[str],
    slice_col: str,
    order: Sequence[Column],
    position: str,
    value: Column,
    out: str,
    forward: bool = True,
) -> DataFrame:
    """Nearest earlier (or, with ``forward=False``, later) non-null ``value``.

    ``position`` is the numeric order column and ``slice_col`` a coarse
    division of it.  Slices carry only their last value, found by ``max_by``.
    """
    pick = F.max_by if forward else F.min_by
    sort = F.asc if forward else F.desc
    carried = df.withColumn("_v", value)
    per_slice = carried.groupBy(*keys, slice_col).agg(
        pick("_v", F.when(F.col("_v").isNotNull(), F.col(position))).alias("_sv")
    )
    before = Window.partitionBy(*keys).orderBy(sort(slice_col)).rowsBetween(Window.unboundedPreceding, -1)
    seeds = per_slice.select(*keys, slice_col, F.last("_sv", ignorenulls=True).over(before).alias("_offset"))
    inner = (
        Window.partitionBy(*keys, slice_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = _join_offsets(carried, seeds, keys, [slice_col])
    return joined.withColumn(
        out, F.coalesce(F.last("_v", ignorenulls=True).over(inner), F.col("_offset"))
    ).drop("_offset", "_v")


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_spread: Column,
    right_spread: Column,
    rows_per_slice: int = 20_000,
    count_left: bool = True,
    counted_as: DataFrame | None = None,
) -> DataFrame:
    """Inner equi-join on ``keys`` whose hot keys are cut into a grid of tasks.

    Counts of both sides (combined on the map side) say which keys have more
    than ``rows_per_slice`` rows; only those are cut: a side of n rows into
    ``ceil(n / rows_per_slice)`` slices by a hash of its spread expression,
    and each side is copied once for every slice of the other.  So a cell holds
    about ``rows_per_slice`` rows a side whatever a key holds, the narrow side
    of a hot key (one slice) is what gets copied, and keys that are not hot
    are joined as they are.  Null keys match nothing.

    Counting computes a side twice.  Where the left side is costly and has few
    rows, ``count_left=False`` cuts by the right side's counts alone and leaves
    a skewed left side to the adaptive join; ``counted_as`` is counted in the
    left side's place, where a cheaper table has as many rows of each key.
    """

    def counted(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))

    n, m = F.col("_n"), F.col("_m")
    both = counted(right, "_m")
    both = both.join(counted(left if counted_as is None else counted_as, "_n"), list(keys)) if count_left else both.withColumn("_n", F.lit(1))
    grid = (
        both.filter((n > rows_per_slice) | (m > rows_per_slice))
        .select(*keys, F.ceil(n / rows_per_slice).cast("int").alias("_a"), F.ceil(m / rows_per_slice).cast("int").alias("_b"))
    )

    def celled(side: DataFrame, spread: Column, own: str, other: str) -> DataFrame:
        slices, copies = F.coalesce(f"_{own}", F.lit(1)), F.coalesce(f"_{other}", F.lit(1))
        cut = F.pmod(F.xxhash64(spread), slices).cast("int").alias(f"_{own}_cell")
        copied = F.explode(F.sequence(F.lit(0), copies - 1)).alias(f"_{other}_cell")
        return side.join(grid, list(keys), "left").select(*side.columns, cut, copied)

    cells = ["_a_cell", "_b_cell"]
    joined = celled(left, left_spread, "a", "b").join(celled(right, right_spread, "b", "a"), [*keys, *cells])
    return joined.drop(*cells)
