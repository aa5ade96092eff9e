"""Continuous ingest of fetched responses into the table store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.plans.ingest import ingest_responses, ingest_round
from skein.session import cut_lineage
from skein.sources.buckets import BucketedTables
from skein.sources.snapshots import exists, touch
from skein.sources.tablestore import LAYOUT, TableStore

CHANGED = ("feeds", "entries", "state", "subscriptions")


def response_turns(fetched: DataFrame) -> list[DataFrame]:
    """All responses of a micro-batch as rounds of one response a feed, each feed's in order of ``at_s``.

    There are as many rounds as the busiest feed has responses in the batch;
    equal times are ordered by the other columns.
    """
    others = [c for c in fetched.columns if c not in ("feed_id", "at_s")]
    order = Window.partitionBy("feed_id").orderBy("at_s", F.xxhash64(*others))
    turned = cut_lineage(fetched.withColumn("_turn", F.row_number().over(order)))
    last = turned.agg(F.max("_turn")).first()[0] or 0
    return [turned.filter(F.col("_turn") == t).drop("_turn") for t in range(1, last + 1)]


def ingest_handler(store: TableStore, clock: Callable[[DataFrame], int]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that publishes one table version per batch.

    A replayed batch id publishes nothing, so every response counts once.
    ``clock`` gives a round's time in epoch seconds.
    """

    def handle(fetched: DataFrame, batch_id: int) -> None:
        done = store.current()["batch"]
        if done is not None and batch_id <= done:
            return
        tables = store.read_all()
        for responses in response_turns(fetched):
            out = ingest_round(tables, responses, clock(responses))
            tables |= {name: cut_lineage(out[name]) for name in CHANGED}
        store.publish({name: tables[name] for name in CHANGED}, batch=batch_id, layout=LAYOUT)

    return handle


def bucketed_handler(tables: BucketedTables) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes each batch once, whatever its responses a feed.

    Two small marker files a batch tell a batch that is done, which is left
    alone, from one that stopped half way, which is finished.
    """

    def handle(fetched: DataFrame, batch_id: int) -> None:
        spark, folder = tables.spark, f"{tables.root}/_batches"
        started, done = (f"{folder}/{batch_id}.{mark}" for mark in ("started", "done"))
        if exists(spark, done):
            return
        again = exists(spark, started)
        touch(spark, started)
        ingest_responses(tables, fetched, batch_id, again)
        touch(spark, done)

    return handle


def batch_time(fetched: DataFrame) -> int:
    """The newest response time of a batch, so that a replay computes the same."""
    row = fetched.agg(F.max("at_s").alias("t")).first()
    return int(row["t"] or 0)


def dedup_items(items: DataFrame, event_time: str, delay: str = "24 hours") -> DataFrame:
    """First sighting of each (feed_id, guid) within the watermark delay."""
    return items.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["feed_id", "guid"])
