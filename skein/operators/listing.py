"""Listing-page candidates: dedup, caps, seen sets and their state fold."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.skew import sliced_rank

MAX_CANDIDATES = 500
MAX_SEEN = 2000
DEFAULT_ITEMS = 20
MAX_ITEMS = 50
MAX_RETRIES = 3
#: Width of one slice of an unbounded seen list, in units of its order column.
SEEN_SLICE = 1 << 16


def effective_items(configured: Column) -> Column:
    return F.when(configured <= 0, DEFAULT_ITEMS).otherwise(F.least(configured, F.lit(MAX_ITEMS)))


def first_per_url(candidates: DataFrame, by: str) -> DataFrame:
    """First candidate of each URL in document order, with dropped duplicates.

    ``n_duplicates`` is how many later copies were folded into the row.
    """
    keep = F.min_by(F.struct(*[c for c in candidates.columns if c not in (by, "url")]), "pos")
    return (
        candidates.groupBy(by, "url")
        .agg(keep.alias("_k"), (F.count(F.lit(1)) - 1).alias("n_duplicates"))
        .select(by, "url", "_k.*", "n_duplicates")
    )


def cap_candidates(matches: DataFrame, by: str) -> DataFrame:
    """The first 500 matches of a page, flagged when there were more.

    ``pos`` numbers the matches of one page from 0.
    """
    last = matches.groupBy(by).agg((F.max("pos") >= MAX_CANDIDATES).alias("truncated"))
    return matches.filter(F.col("pos") < MAX_CANDIDATES).join(last, by)


def cap_items(fresh: DataFrame, by: str, limit: Column) -> DataFrame:
    """The first ``limit`` new candidates of each source, document order."""
    # A source offers at most MAX_CANDIDATES rows per crawl.
    order = Window.partitionBy(by).orderBy("pos")
    return fresh.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).drop("_n")


def unseen(candidates: DataFrame, seen: DataFrame, by: str) -> DataFrame:
    return candidates.join(seen.select(by, "url"), [by, "url"], "left_anti")


def with_seen_flag(candidates: DataFrame, seen: DataFrame, by: str) -> DataFrame:
    mine = seen.select(by, "url").distinct().withColumn("_s", F.lit(True))
    return candidates.join(mine, [by, "url"], "left").withColumn("seen", F.col("_s").isNotNull()).drop("_s")


def listing_decision() -> Column:
    """Outcome of a listing crawl from matched, has_state and state_valid.

    No match at all is an error; an unreadable state seals the current
    candidates as seen without importing them.
    """
    return (
        F.when(F.col("matched") == 0, "error")
        .when(F.col("has_state") & ~F.col("state_valid"), "resync")
        .when(F.col("n_new") == 0, "nothing_new")
        .otherwise("new_items")
    )


def gives_up(prev_failures: Column) -> Column:
    """Whether one more failure imports the article by title only."""
    return F.coalesce(prev_failures, F.lit(0)) + 1 >= MAX_RETRIES


class ListingState(NamedTuple):
    seen: DataFrame
    pending: DataFrame


def commit_state(
    seen: DataFrame,
    pending: DataFrame,
    candidates: DataFrame,
    imported: DataFrame,
    failed: DataFrame,
    initial: DataFrame,
    by: str = "source",
    max_seen: int | None = MAX_SEEN,
) -> ListingState:
    """Fold one crawl into the per-source seen list and retry counters.

    ``seen`` (by, url, seq), ``pending`` (by, url, n), ``candidates`` and
    ``imported`` (by, url, pos), ``failed`` (by, url), ``initial`` (by) the
    sources on their first crawl.  Sources without a candidate keep their
    state.  ``max_seen`` bounds a source's list, and so the windows per source;
    None keeps every URL, and the list is then numbered slice by slice.
    """
    active = candidates.select(by).distinct()
    keys = [by, "url"]
    cand = candidates.select(*keys).distinct().withColumn("_cand", F.lit(True))

    sealed = candidates.join(initial.select(by).distinct(), by, "left_semi").join(
        failed.select(*keys), keys, "left_anti"
    )
    ordered = (
        seen.select(*keys, F.lit(0).alias("_rule"), F.col("seq").alias("_at"))
        .unionByName(imported.select(*keys, F.lit(1).alias("_rule"), F.col("pos").alias("_at")))
        .unionByName(sealed.select(*keys, F.lit(2).alias("_rule"), F.col("pos").alias("_at")))
        .groupBy(*keys)
        .agg(F.min(F.struct("_rule", "_at")).alias("_o"))
        .join(active, by, "left_semi")
        .join(cand, keys, "left")
    )
    if max_seen is None:
        flat = ordered.select(*keys, "_o._rule", "_o._at", F.floor(F.col("_o._at") / SEEN_SLICE).alias("_slice"))
        slices = ["_rule", "_slice"]
        numbered = sliced_rank(flat, [by], slices, [F.asc(c) for c in slices], [F.asc("_at"), F.asc("url")], "seq")
        kept = numbered.select(*keys, (F.col("seq") - 1).alias("seq"))
    else:
        in_order = Window.partitionBy(by).orderBy("_o", "url")
        evictable = F.col("_cand").isNull()
        ranked = ordered.withColumns(
            {
                "_total": F.count(F.lit(1)).over(Window.partitionBy(by)),
                "_evictable": F.sum(evictable.cast("int")).over(
                    in_order.rowsBetween(Window.unboundedPreceding, 0)
                ),
            }
        )
        evicted = evictable & (F.col("_evictable") <= F.col("_total") - max_seen)
        kept = ranked.filter(~evicted).select(*keys, (F.row_number().over(in_order) - 1).alias("seq"))
    idle_seen = seen.join(active, by, "left_anti").select(*keys, "seq")

    counted = (
        pending.join(cand.select(*keys), keys, "left_semi")
        .join(imported.select(*keys), keys, "left_anti")
        .select(*keys, F.col("n"))
        .unionByName(failed.select(*keys, F.lit(1).alias("n")))
        .groupBy(*keys)
        .agg(F.sum("n").alias("n"))
    )
    idle_pending = pending.join(active, by, "left_anti").select(*keys, "n")
    return ListingState(idle_seen.unionByName(kept), idle_pending.unionByName(counted))
