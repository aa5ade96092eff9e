"""Extraction kinds that can be plugged in.

An extractor turns the pages of its sources into item rows and the next saved
state: ``run(sources, pages, state, now) -> Extraction``.  ``state`` and the
returned state are whatever tables the extractor keeps, by name.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.listing import listing_round
from skein.plans.watch import watch_round

ITEM_COLUMNS = ["source", "guid", "url", "title", "body", "published_at"]


class Extraction(NamedTuple):
    items: DataFrame
    state: Mapping[str, DataFrame]


Extractor = Callable[[DataFrame, DataFrame, Mapping[str, DataFrame], int], Extraction]
_KINDS: dict[str, Extractor] = {}


def register(kind: str) -> Callable[[Extractor], Extractor]:
    def add(fn: Extractor) -> Extractor:
        _KINDS[kind] = fn
        return fn

    return add


def kinds() -> list[str]:
    return sorted(_KINDS)


@register("pagewatch")
def _pagewatch(sources: DataFrame, pages: DataFrame, state: Mapping[str, DataFrame], now: int) -> Extraction:
    entries, baselines, runs, _ = watch_round(
        sources.withColumnRenamed("source", "source_id"),
        pages.withColumnRenamed("source", "source_id"),
        state["baselines"],
        state["runs"],
        now,
    )
    items = entries.withColumnRenamed("source_id", "source")
    return Extraction(items.select(*ITEM_COLUMNS), {"baselines": baselines, "runs": runs})


@register("selector")
def _selector(sources: DataFrame, pages: DataFrame, state: Mapping[str, DataFrame], now: int) -> Extraction:
    out = listing_round(
        sources, pages, state["articles"], state["seen"], state["pending"], state["rules"], now
    )
    return Extraction(out.entries.select(*ITEM_COLUMNS), {"seen": out.state.seen, "pending": out.state.pending})


def extract(
    sources: DataFrame, pages: DataFrame, states: Mapping[str, Mapping[str, DataFrame]], now: int
) -> tuple[DataFrame, dict[str, Mapping[str, DataFrame]]]:
    """Run every registered kind over its own sources: (items, next states).

    ``sources`` carries a ``kind`` column; kinds without a state are skipped.
    """
    items, after = None, {}
    for kind in kinds():
        if kind not in states:
            continue
        mine = sources.filter(F.col("kind") == kind).drop("kind")
        result = _KINDS[kind](mine, pages, states[kind], now)
        tagged = result.items.withColumn("kind", F.lit(kind))
        items = tagged if items is None else items.unionByName(tagged)
        after[kind] = result.state
    if items is None:
        raise ValueError("no extractor has a state")
    return items, after
