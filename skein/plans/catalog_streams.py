"""Streaming operators run over the driver tables as arriving files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skein.operators import boilerplate
from skein.operators.stats import DURATION_BUCKETS
from skein.plans.registry import query
from skein.session import shared_dir
from skein.sources import dom
from skein.streaming import keyed, metrics
from skein.streaming.ingest import dedup_items
from skein.streaming.runner import file_stream, run_to_files

HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"


def stream_of(fx, table: str):
    return file_stream(fx.spark, fx.sf_dir, fx.raw(table).schema, f"{table}.parquet")


def event_log(events):
    """The fetch log of the fixtures, from a batch or a stream of events."""
    return events.selectExpr(
        "event_id AS seq",
        "event_id % 19 AS feed_id",
        "CAST(ts AS TIMESTAMP) AS at",
        "value / 8 AS duration_s",
        "CASE event_type WHEN 'purchase' THEN 'not_modified' WHEN 'error' THEN 'error' ELSE 'ok' END AS status",
        "CASE WHEN event_type IN ('view', 'signup') THEN event_id % 4 ELSE 0 END AS new_entries",
    )


def interval_events(events):
    return event_log(events).selectExpr(
        "feed_id", "seq", "status", "new_entries", "CASE WHEN seq % 97 = 0 THEN 1200L ELSE 0L END AS retry_after",
        "seq % 60 AS jitter", "1800L AS start_sec",
    )


def page_versions(blocks):
    """(source, version, keys): the blocks of a page version in document order."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "html")))
    return blocks.groupBy("source", "version").agg(F.transform(rows, lambda r: r["html"]).alias("keys"))


def stored_stream(df, name: str):
    """A stream over the rows of ``df``, written once to shared storage."""
    folder = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return file_stream(df.sparkSession, folder, df.schema)


def listing_crawls(pages):
    found = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return pages.select(
        F.expr(HOST).alias("source"),
        F.col("page_id").alias("crawl"),
        found.alias("urls"),
        F.filter(found, lambda u: F.pmod(F.crc32(u), F.lit(4)) == 0).alias("failing"),
        F.lit(3).alias("max_items"),
    )


def feed_pages(pages):
    return pages.select(F.expr(HOST).alias("feed_id"), "page_id", "html")


_BUCKETS = ", ".join(f"count(*) FILTER (duration_s <= {le}) AS le_{i}" for i, le in enumerate(DURATION_BUCKETS))


@query(
    "hourly_fetch_metrics",
    f"""SELECT status, {_BUCKETS}, count(*) AS le_inf, round(sum(duration_s), 5) AS duration_sum, count(*) AS duration_count, hour
FROM (SELECT epoch(date_trunc('hour', ts))::BIGINT AS hour, value / 8 AS duration_s,
  CASE event_type WHEN 'purchase' THEN 'not_modified' WHEN 'error' THEN 'error' ELSE 'ok' END AS status FROM events) e GROUP BY status, hour""",
)
def _(fx):
    out = metrics.fetch_metrics(event_log(fx.raw("events")))
    return out.withColumn("duration_sum", F.round("duration_sum", 5))


@query("stream_fetch_metrics")
def _(fx):
    return run_to_files(metrics.fetch_metrics(event_log(stream_of(fx, "events"))), "fetch-metrics")


@query("stream_feed_intervals")
def _(fx):
    return run_to_files(keyed.chained_intervals(interval_events(stream_of(fx, "events"))), "intervals")


@query("stream_item_dedup")
def _(fx):
    items = stream_of(fx, "events").selectExpr(
        "event_id % 19 AS feed_id", "CAST(event_id % 100 AS STRING) AS guid", "CAST(ts AS TIMESTAMP) AS at"
    )
    return run_to_files(dedup_items(items, "at", "100 days").select("feed_id", "guid"), "dedup")


@query(
    "stream_page_watch",
    """WITH v AS (SELECT source, version, string_agg(html, chr(10) ORDER BY pos) AS page FROM fx_blocks GROUP BY source, version),
l AS (SELECT *, lag(version) OVER w AS previous, lag(page) OVER w AS was FROM v WINDOW w AS (PARTITION BY source ORDER BY version)),
k AS (SELECT source, version, html, count(*) AS n FROM fx_blocks GROUP BY source, version, html),
s AS (SELECT l.source, l.version, k.html, k.n AS n FROM l JOIN k ON k.source = l.source AND k.version = l.version WHERE previous IS NOT NULL
  UNION ALL SELECT l.source, l.version, k.html, -k.n FROM l JOIN k ON k.source = l.source AND k.version = l.previous),
d AS (SELECT source, version, sum(greatest(n, 0))::BIGINT AS a, sum(greatest(-n, 0))::BIGINT AS r
  FROM (SELECT source, version, html, sum(n) AS n FROM s GROUP BY source, version, html) t GROUP BY source, version),
o AS (SELECT source, version, page, CASE WHEN previous IS NULL THEN 'started' WHEN was = page THEN 'unchanged' WHEN a > 0 THEN 'changed' ELSE 'hidden' END AS decision,
  coalesce(a, 0) AS n_added, coalesce(r, 0) AS n_removed FROM l LEFT JOIN d USING (source, version))
SELECT source, version, decision, CASE WHEN decision IN ('started', 'changed') THEN sha256(sha256(page)) END AS guid, n_added, n_removed FROM o""",
)
def _(fx):
    versions = stored_stream(page_versions(fx.blocks), "watch-versions")
    return run_to_files(keyed.watch_versions(versions), "watch")


@query("stream_listing_state")
def _(fx):
    return run_to_files(keyed.listing_crawls(listing_crawls(stream_of(fx, "pages"))), "listing")


@query("stream_learned_boilerplate")
def _(fx):
    pages = feed_pages(stream_of(fx, "pages"))
    digests = dom.page_digests(pages, boilerplate.MAX_DEPTH, boilerplate.MIN_TEXT)
    return run_to_files(keyed.learned_cuts(digests), "boilerplate")
