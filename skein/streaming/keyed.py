"""Order-dependent state per key, folded event by event.

Each processor keeps a bounded state per key and sorts only what one
micro-batch brought for that key, so memory does not grow with history.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skein.operators import blocks, boilerplate, feeds, listing

NANOS = feeds.NANOS


def _ordered(rows: Iterator[pd.DataFrame], *order: str) -> Iterator:
    return pd.concat(list(rows)).sort_values(list(order)).itertuples(index=False)


def apply_state(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    return stream.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None"
    )


# ------------------------------------------------------------------ adaptive intervals

INTERVAL_SCHEMA = "feed_id bigint, seq bigint, interval_sec bigint, error_count bigint"


def next_interval(current: int, errors: int, status: str, new: int, retry: int, jitter: int) -> tuple[int, int]:
    """One step of the schedule, as the column forms in ``operators.feeds``."""
    current = current if current > 0 else feeds.MIN_INTERVAL
    if status in ("ok", "not_modified"):
        scaled = int(float(current * NANOS) * (0.7 if status == "ok" and new > 0 else 1.3))
        low, high = feeds.MIN_INTERVAL * NANOS, feeds.MAX_INTERVAL * NANOS
        return min(max(scaled, low), high) // NANOS, 0
    after = errors + 1
    if retry > 0:
        wait = min(retry, feeds.MAX_ERROR_INTERVAL)
    else:
        wait = (current << min(after, feeds.MAX_SHIFT)) + jitter
        wait = min(max(wait, feeds.MIN_INTERVAL), feeds.MAX_ERROR_INTERVAL)
    return wait, feeds.STOPPED_ERRORS if status == "gone" else after


class IntervalProcessor(StatefulProcessor):
    """(feed_id, seq, status, new_entries, retry_after, jitter, start_sec) in order of seq."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("schedule", "interval_sec bigint, error_count bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        out = []
        for r in _ordered(rows, "seq"):
            current, errors = held or (int(r.start_sec), 0)
            held = next_interval(
                int(current), int(errors), r.status, int(r.new_entries), int(r.retry_after), int(r.jitter)
            )
            out.append((key[0], r.seq, *held))
        self.state.update(held)
        yield pd.DataFrame(out, columns=["feed_id", "seq", "interval_sec", "error_count"])

    def close(self) -> None:
        pass


def chained_intervals(log: DataFrame) -> DataFrame:
    return apply_state(log, "feed_id", IntervalProcessor(), INTERVAL_SCHEMA)


# ------------------------------------------------------------------ watched pages

WATCH_SCHEMA = "source string, version bigint, decision string, guid string, n_added int, n_removed int"


class WatchProcessor(StatefulProcessor):
    """Page versions (source, version, keys) against the source's previous keys.

    Additions mode with default settings; ``keys`` are the masked blocks in
    document order and are the state kept per source.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("baseline", "keys array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.state.get()[0]) if self.state.exists() else None
        out = []
        for r in _ordered(rows, "version"):
            keys = list(r.keys)
            guid = hashlib.sha256(hashlib.sha256("\n".join(keys).encode()).hexdigest().encode()).hexdigest()
            if held is None:
                decision, added, removed = blocks.STARTED, 0, 0
            elif held == keys:
                decision, added, removed = blocks.UNCHANGED, 0, 0
            else:
                was, now = Counter(held), Counter(keys)
                added, removed = (now - was).total(), (was - now).total()
                decision = blocks.CHANGED if added else blocks.HIDDEN
            held = keys
            shown = guid if decision in (blocks.STARTED, blocks.CHANGED) else None
            out.append((key[0], r.version, decision, shown, added, removed))
        self.state.update((held,))
        yield pd.DataFrame(out, columns=["source", "version", "decision", "guid", "n_added", "n_removed"])

    def close(self) -> None:
        pass


def watch_versions(versions: DataFrame) -> DataFrame:
    return apply_state(versions, "source", WatchProcessor(), WATCH_SCHEMA)


# ------------------------------------------------------------------ listing state

LISTING_SCHEMA = "source string, crawl bigint, url string, action string, failures int"


def fold_listing(
    seen: list[str], pending: dict[str, int], candidates: list[str], failing: set[str], limit: int, initial: bool
) -> tuple[list[str], dict[str, int], list[tuple[str, str, int]]]:
    """One crawl of a listing: what is imported and the next state."""
    known = set(seen)
    fresh = [u for u in dict.fromkeys(candidates) if u not in known]
    if not fresh:
        return seen, pending, []
    actions, imported, failed = [], [], []
    for url in fresh[:limit]:
        tries = pending.get(url, 0)
        if url not in failing or tries + 1 >= listing.MAX_RETRIES:
            imported.append(url)
            actions.append((url, "title_only" if url in failing else "imported", tries))
        else:
            failed.append(url)
            actions.append((url, "failed", tries + 1))
    sealed = [u for u in fresh if u not in failed] if initial else []
    order = list(dict.fromkeys([*seen, *imported, *sealed]))
    shown = set(fresh)
    left = {u: n for u, n in pending.items() if u in shown and u not in imported}
    for url in failed:
        left[url] = left.get(url, 0) + 1
    excess = len(order) - listing.MAX_SEEN
    if excess > 0:
        drop = set([u for u in order if u not in shown][:excess])
        order = [u for u in order if u not in drop]
    return order, left, actions


class ListingProcessor(StatefulProcessor):
    """Crawls (source, crawl, urls, failing, max_items) in order of crawl."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("listing", "seen array<string>, pending string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        initial = held is None
        seen, pending = ([], {}) if held is None else (list(held[0]), json.loads(held[1]))
        out = []
        for r in _ordered(rows, "crawl"):
            seen, pending, actions = fold_listing(
                seen, pending, list(r.urls), set(r.failing), int(r.max_items), initial
            )
            # A crawl without new candidates writes no state, so the next is still the first.
            initial = initial and not actions
            out += [(key[0], r.crawl, *a) for a in actions]
        if not initial:
            self.state.update((seen, json.dumps(pending)))
        yield pd.DataFrame(out, columns=["source", "crawl", "url", "action", "failures"])

    def close(self) -> None:
        pass


def listing_crawls(crawls: DataFrame) -> DataFrame:
    return apply_state(crawls, "source", ListingProcessor(), LISTING_SCHEMA)


# ------------------------------------------------------------------ learned boilerplate

CUT_SCHEMA = "feed_id string, page_id bigint, pos int, sig string"


def fold_page(
    counts: dict[str, list[int]], pages: int, subtrees: list[tuple[int, int, str, int, int]]
) -> tuple[dict[str, list[int]], int, list[tuple[int, str]]]:
    """Cut one page and learn from it.

    ``subtrees`` are (pos, end, sig, text_len, link_len) in document order;
    what lies inside a cut subtree is neither looked at nor learned.
    """
    cut: list[tuple[int, str]] = []
    sigs: dict[str, None] = {}
    covered = -1
    for pos, end, sig, text_len, link_len in subtrees:
        if pos <= covered:
            continue
        sigs[sig] = None
        n = counts.get(sig, (0, 0))[0]
        chrome = text_len == 0 or link_len * 2 >= text_len
        if n >= boilerplate.MIN_PAGES and n * 2 >= pages and chrome:
            cut.append((pos, sig))
            covered = end
    pages += 1
    for sig in sigs:
        counts[sig] = [counts.get(sig, (0, 0))[0] + 1, pages]
    if pages >= boilerplate.DECAY_PAGES:
        counts = {s: [c // 2, seen] for s, (c, seen) in counts.items() if c // 2 > 0}
        pages //= 2
    if len(counts) > boilerplate.MAX_SIGNATURES:
        best = sorted(counts.items(), key=lambda kv: (kv[1][0], kv[1][1], kv[0]))[-boilerplate.MAX_SIGNATURES :]
        counts = dict(best)
    return counts, pages, cut


class BoilerplateProcessor(StatefulProcessor):
    """Pages (feed_id, page_id, subtrees) in order of page_id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getValueState("pages", "n bigint")
        self.counts = handle.getMapState("counts", "sig string", "count bigint, last_seen bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pages = self.pages.get()[0] if self.pages.exists() else 0
        held = {k[0]: [v[0], v[1]] for k, v in self.counts.iterator()} if pages else {}
        before = dict(held)
        out = []
        for r in _ordered(rows, "page_id"):
            subtrees = [
                (s["pos"], s["end"], s["sig"], s["text_len"], s["link_len"]) for s in r.subtrees
            ]
            held, pages, cut = fold_page(held, pages, sorted(subtrees))
            out += [(key[0], r.page_id, pos, sig) for pos, sig in cut]
        for sig in before.keys() - held.keys():
            self.counts.removeKey((sig,))
        for sig, value in held.items():
            if before.get(sig) != value:
                self.counts.updateValue((sig,), tuple(value))
        self.pages.update((pages,))
        yield pd.DataFrame(out, columns=["feed_id", "page_id", "pos", "sig"])

    def close(self) -> None:
        pass


def learned_cuts(pages: DataFrame) -> DataFrame:
    return apply_state(pages, "feed_id", BoilerplateProcessor(), CUT_SCHEMA)
