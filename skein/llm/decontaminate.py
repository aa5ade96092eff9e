"""Benchmark decontamination by an FM-index per training shard.

A shard is one Arrow batch of documents.  Words that no benchmark item holds
cannot be part of an occurrence, so they act as separators; runs of benchmark
words too short for any window are left out, and the rest is indexed.  All
windows of the benchmark (10 consecutive words of an item; a shorter item is
one window) are searched backwards at once, their occurrences located by
sampled suffix positions, and hit words merged to removal spans.  Word hashes
only propose; the bytes of every proposed word are compared.

The benchmark goes to the tasks in blocks of ``BLOCK_BYTES`` of text, whatever
its size: with more blocks than one the documents pass one mapping a block and
carry their spans along.  No shuffle happens.  Null and empty texts or items
have no words; a null item_id is reported as ``null``; repeated items report
one id; every row of a repeated document is handled by itself; all other
columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import map_batches
from skein.llm.fm_index import FMIndex
from skein.llm.textbytes import find_words, text_bytes

WINDOW = 10
BLOCK_BYTES = 16 << 20
SEPARATOR = 1
RANGE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("byte_start", pa.int64()), ("byte_end", pa.int64())])


class Block(NamedTuple):
    """Windows of some benchmark items over a vocabulary of their words."""

    hashes: np.ndarray  # sorted word hashes; symbol 2 + place
    lengths: np.ndarray
    heads: np.ndarray  # byte offset of each word in ``letters``
    letters: np.ndarray
    windows: list[np.ndarray]  # per length: one window of symbols a row
    owners: list[list[np.ndarray]]  # per length and window: item numbers
    items: list[str]
    least: int


def build_block(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> Block:
    names = ["null" if i is None else i for i, _ in items]
    words = find_words(*text_bytes(pa.array([t for _, t in items], pa.large_string())))
    hashes, first = np.unique(words.hashes, return_index=True)
    spelled = {words.lower[s:e].tobytes() for s, e in zip(words.starts, words.ends, strict=True)}
    if len(spelled) != len(hashes):
        raise ValueError("two benchmark words share a 64-bit hash")
    lengths = (words.ends - words.starts)[first]
    letters = np.concatenate([words.lower[words.starts[i] : words.ends[i]] for i in first] or [np.zeros(0, np.uint8)])
    symbols = np.searchsorted(hashes, words.hashes) + 2
    found: dict[int, dict[tuple[int, ...], set[int]]] = {}
    for item in range(len(items)):
        own = symbols[words.first[item] : words.first[item + 1]].tolist()
        size = min(window, len(own))
        for at in range(len(own) - size + 1 if size else 0):
            found.setdefault(size, {}).setdefault(tuple(own[at : at + size]), set()).add(item)
    sizes = sorted(found)
    return Block(
        hashes,
        lengths,
        np.concatenate([[0], np.cumsum(lengths)])[:-1].astype(np.int64),
        letters,
        [np.array(list(found[s]), np.int64) for s in sizes],
        [[np.array(sorted(o)) for o in found[s].values()] for s in sizes],
        names,
        sizes[0] if sizes else 0,
    )


def _symbols(words, block: Block) -> np.ndarray:
    """Benchmark symbol of every word, 0 for others; hash matches are compared byte by byte."""
    place = np.minimum(np.searchsorted(block.hashes, words.hashes), len(block.hashes) - 1)
    known = np.flatnonzero(block.hashes[place] == words.hashes)
    lengths = (words.ends - words.starts)[known]
    same = lengths == block.lengths[place[known]]
    for size in np.unique(lengths):
        pick = np.flatnonzero(same & (lengths == size))
        span = np.arange(size)
        mine = words.lower[words.starts[known[pick]][:, None] + span]
        theirs = block.letters[block.heads[place[known[pick]]][:, None] + span]
        same[pick] = (mine == theirs).all(axis=1)
    out = np.zeros(len(words.hashes), np.int64)
    out[known[same]] = place[known[same]] + 2
    return out


def _occurrences(words, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, int, list[np.ndarray]]]:
    """(window numbers, first words, window size, owners) for each window size."""
    if not block.windows or not len(words.hashes):
        return
    symbols = _symbols(words, block)
    inside = symbols > 0
    joined = inside[1:] & inside[:-1]
    heads = words.first[(words.first > 0) & (words.first < len(symbols))]
    joined[heads - 1] = False
    opens = np.flatnonzero(inside & np.concatenate([[True], ~joined]))
    closes = np.flatnonzero(inside & np.concatenate([~joined, [True]])) + 1
    long = closes - opens >= block.least
    opens, closes = opens[long], closes[long]
    if not len(opens):
        return
    # Runs one after the other, each behind a separator; place[] maps back to words.
    sizes = closes - opens + 1
    ends = np.cumsum(sizes)
    place = np.repeat(opens - 1 - (ends - sizes), sizes) + np.arange(ends[-1])
    text = symbols[np.maximum(place, 0)]
    text[ends - sizes] = SEPARATOR
    index = FMIndex(text)
    for patterns, owners in zip(block.windows, block.owners, strict=True):
        low, high = index.search(patterns)
        hits = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(patterns)), hits)
        rows = np.repeat(low - (np.cumsum(hits) - hits), hits) + np.arange(hits.sum())
        if len(rows):
            yield which, place[index.locate(rows)], patterns.shape[1], owners


def _scan(texts: pa.Array, block: Block) -> tuple[np.ndarray, list[list[tuple[int, int, int, int]]], list[set[str]]]:
    """Per row: number of words, merged hit ranges (words and bytes), ids of the items found."""
    data, offsets = text_bytes(texts)
    words = find_words(data, offsets)
    cover = np.zeros(len(words.hashes) + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(len(texts))]
    for which, starts, size, owners in _occurrences(words, block):
        np.add.at(cover, starts, 1)
        np.add.at(cover, starts + size, -1)
        pairs = np.unique(np.stack([words.row_of(starts), which]), axis=1)
        for row, window in pairs.T.tolist():
            items[row].update(block.items[o] for o in owners[window])
    hit = np.cumsum(cover)[:-1] > 0
    edge = np.flatnonzero(hit)
    spans: list[list[tuple[int, int, int, int]]] = [[] for _ in range(len(texts))]
    if len(edge):
        row = words.row_of(edge)
        split = np.flatnonzero((np.diff(edge) > 1) | (np.diff(row) > 0)) + 1
        for r, s, e in zip(
            row[np.concatenate([[0], split])].tolist(),
            edge[np.concatenate([[0], split])].tolist(),
            edge[np.concatenate([split - 1, [len(edge) - 1]])].tolist(),
            strict=True,
        ):
            base, shift = int(words.first[r]), int(offsets[r])
            spans[r].append((s - base, e + 1 - base, int(words.starts[s]) - shift, int(words.ends[e]) - shift))
    return np.diff(words.first), spans, items


def _merged(ranges: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    out: list[tuple[int, int, int, int]] = []
    for s, e, bs, be in sorted(ranges):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e, out[-1][2], be)
        else:
            out.append((s, e, bs, be))
    return out


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[Block]:
    """The benchmark in blocks by a hash of the id, each of about ``block_bytes`` of text."""
    narrow = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    total = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for b in range(blocks):
        part = narrow.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b) if blocks > 1 else narrow
        yield build_block([tuple(r) for r in part.collect()])


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``doc`` (all columns of the row), n_words, ``ranges`` of hit words and ``items`` found."""
    spark = docs.sparkSession
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    df = docs.select(
        row.alias("doc"),
        F.col(text_col).alias("text"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.expr("cast(array() as array<struct<start:bigint,end:bigint,byte_start:bigint,byte_end:bigint>>)").alias(
            "ranges"
        ),
        F.expr("cast(array() as array<string>)").alias("items"),
    )
    schema = df.schema
    for block in benchmark_blocks(benchmark, item_col, item_text_col, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_words, spans, items = _scan(batch.column("text"), shared.value)
                for i, old in enumerate(batch.column("ranges").to_pylist()):
                    if old:
                        spans[i] = _merged([*spans[i], *(tuple(o.values()) for o in old)])
                for i, old in enumerate(batch.column("items").to_pylist()):
                    items[i].update(old)
                keys = ("start", "end", "byte_start", "byte_end")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc"),
                        batch.column("text"),
                        pa.array(n_words, pa.int64()),
                        pa.array([[dict(zip(keys, s, strict=True)) for s in x] for x in spans], pa.list_(RANGE)),
                        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    ],
                    ["doc", "text", "n_words", "ranges", "items"],
                )

        df = map_batches(df, run, schema)
    return df.drop("text")


def remove_contamination(docs: DataFrame, benchmark: DataFrame, **columns: str) -> DataFrame:
    """``docs`` with every hit range cut from the text, a blank in its place."""
    text_col = columns.get("text_col", "text")
    found = find_contamination(docs, benchmark, **columns)
    raw = F.encode(F.col(f"doc.`{text_col}`"), "UTF-8")
    ends = F.concat(F.transform("ranges", lambda r: r["byte_start"]), F.array(F.octet_length(raw).cast("bigint")))
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("ranges", lambda r: r["byte_end"]))
    pieces = F.zip_with(
        starts, ends, lambda s, e: F.decode(F.substring(raw, s.cast("int") + 1, (e - s).cast("int")), "UTF-8")
    )
    text = F.when(F.size("ranges") > 0, F.array_join(pieces, " ")).otherwise(F.col(f"doc.`{text_col}`"))
    return found.select(*[text.alias(c) if c == text_col else F.col(f"doc.`{c}`") for c in docs.columns])
