"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors become integers (``floor(scale * x)``).  The index is a table of
shards of at most ``SHARD_ROWS`` vectors, cut inside a task without an
exchange.  For each dimension a shard keeps its rows ordered by value and
``LEVELS`` posting segments, one a quantised impact, with the values they
reach.  A query reads a dimension from the high end where its weight is
positive and from the low end where it is negative, so every impact (weight
times distance from the other end) is at least 0.

A query takes the segments of all dimensions by descending quantised impact,
adding each to the accumulators of its rows.  After a wave down to impact t, a
row's score is at most its accumulator plus min(t, best impact) for each
dimension it was not met in.  The k-th best exact score known so far is a
proven floor: rows whose bound is under it cannot be members.  Once the
possible members are at most a ``RESCORE_SHARE`` of the shard (or no segment
is left), all of them are scored exactly, in integers.  Nothing is sampled or
cut: a row is left out only by that proof.

Queries go in blocks of bounded bytes, each broadcast to one pass over the
index; a task returns one packed row of its best k a block, and packed rows
are merged ``FAN_IN`` at a time, so no group grows with the table.

Rows with a null id, a null vector, or a null or non-finite component take no
part, nor do those with a component of 2**52 or more.  Shorter vectors count
as if zeros followed; an empty vector scores 0 with all.  A query's own id is
no candidate for it.  Rows that repeat id and vector are one query; as
candidates each row counts.  Equal scores are ordered by the smaller id.
Scores beyond 64 bits are cut to the nearest long.  Empty tables give an empty
result, other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import map_batches, stored

SHARD_ROWS, LEVELS = 8192, 32
#: Shares of a shard's postings after which the bounds are looked at.
WAVES = (0.3, 0.45, 0.6, 0.8, 1.0)
RESCORE_SHARE = 0.25
QUERY_BYTES, QUERY_ROWS = 8 << 20, 4096
FAN_IN = 16
_LONG = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Whether all components of an array column are numbers that scale to integers exactly."""
    limit = float(1 << 52)
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= limit))
    return vector.isNotNull() & ~bad


def _narrow(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    found = vectors.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")
    )
    return found.filter(F.col("id").isNotNull() & usable(F.col("vector")))


def scaled(vectors: pa.ListArray, width: int, scale: int) -> np.ndarray:
    """Rows x width of ``floor(scale * x)``; shorter rows end in zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False) * float(scale)).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


class Shard(NamedTuple):
    """Vectors of a part of the table with their postings, dimension by dimension."""

    ids: np.ndarray
    vectors: np.ndarray
    order: np.ndarray  # width x rows: rows by ascending value
    bounds: np.ndarray  # width x (LEVELS + 1): where each segment starts in the order
    low: np.ndarray  # width x LEVELS: least value of the segment
    high: np.ndarray


def build_shard(ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS) -> Shard:
    rows, width = vectors.shape
    order = np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32)
    values = np.take_along_axis(vectors.T, order, axis=1)
    least, span = values[:, :1], np.maximum(values[:, -1:] - values[:, :1], 1)
    level = np.minimum((values - least).astype(np.float64) / span * levels, levels - 1).astype(np.int64)
    bounds = np.zeros((width, levels + 1), np.int32)
    low, high = np.zeros((width, levels), np.int64), np.zeros((width, levels), np.int64)
    for d in range(width):
        bounds[d] = np.searchsorted(level[d], np.arange(levels + 1))
        low[d] = values[d, np.minimum(bounds[d, :-1], rows - 1)]
        high[d] = values[d, np.maximum(bounds[d, 1:] - 1, 0)]
    return Shard(ids, vectors, order, bounds, low, high)


INDEX_SCHEMA = "n_rows int, width int, ids binary, vectors binary, postings binary, bounds binary, low binary, high binary"


def build_index(
    vectors: DataFrame, id_col: str, vector_col: str, scale: int = 1024, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """The index of ``vectors``, one row a shard, written to the shared folder."""
    narrow = _narrow(vectors, id_col, vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        rows = 0

        def close() -> pa.RecordBatch:
            part = pa.Table.from_batches(waiting).combine_chunks()
            column = part.column("vector").chunk(0)
            width = int(np.diff(column.offsets.to_numpy()).max(initial=0))
            shard = build_shard(part.column("id").to_numpy(), scaled(column, width, scale))
            packed = [a.tobytes() for a in shard]
            return pa.RecordBatch.from_arrays(
                [pa.array([len(column)], pa.int32()), pa.array([width], pa.int32())]
                + [pa.array([p], pa.binary()) for p in packed],
                ["n_rows", "width", "ids", "vectors", "postings", "bounds", "low", "high"],
            )

        for batch in batches:
            for at in range(0, batch.num_rows, shard_rows):
                piece = batch.slice(at, shard_rows)
                if rows + piece.num_rows > shard_rows:
                    yield close()
                    waiting, rows = [], 0
                waiting.append(piece)
                rows += piece.num_rows
        if rows:
            yield close()

    return stored(map_batches(narrow, run, INDEX_SCHEMA), "impact-index")


def _unpacked(row: dict) -> Shard:
    rows, width = row["n_rows"], row["width"]
    return Shard(
        np.frombuffer(row["ids"], np.int64),
        np.frombuffer(row["vectors"], np.int64).reshape(rows, width),
        np.frombuffer(row["postings"], np.int32).reshape(width, rows),
        np.frombuffer(row["bounds"], np.int32).reshape(width, -1),
        *(np.frombuffer(row[c], np.int64).reshape(width, -1) for c in ("low", "high")),
    )


def _exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond 64 bits cut to the nearest long."""
    width = vectors.shape[1]
    reach = int(np.abs(vectors).max(initial=0)) * int(np.abs(query).max(initial=0)) * max(width, 1)
    if reach < 1 << 53:
        return (vectors.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    if reach <= _LONG:
        return vectors @ query
    products = vectors.astype(object) @ query.astype(object)
    return np.array([max(-_LONG - 1, min(_LONG, int(p))) for p in products], np.int64)


class Searcher:
    """One shard, ready for any number of queries."""

    def __init__(self, shard: Shard) -> None:
        self.shard = shard
        sizes = np.diff(shard.bounds, axis=1)
        self._sizes, self._filled = sizes, sizes > 0
        self._levels = np.repeat(
            np.tile(np.arange(sizes.shape[1], dtype=np.int8), len(sizes)), sizes.ravel()
        ).reshape(shard.order.shape)

    def possible(self, query: np.ndarray, k: int, floor: int | None, own: int) -> np.ndarray:
        """Rows that may be among the best ``k``: all but those proven to be under ``floor`` or k others."""
        shard, (width, rows) = self.shard, self.shard.order.shape
        weight = np.abs(query).astype(np.float64)
        rising = query > 0
        # Impacts in floating point, rounded up when quantised below.
        reach = np.where(rising[:, None], shard.high - shard.low[:, :1], shard.high[:, -1:] - shard.low)
        impact = weight[:, None] * np.maximum(reach, 0)
        best = float(impact.max(axis=1, initial=0).sum())
        unit = max(best / (1 << 40), 1e-300)
        impact = np.where(self._filled, np.ceil(impact / unit * (1 + 1e-12)), 0).astype(np.int64)
        ends = np.where(rising, shard.low[:, 0], shard.high[:, -1]).astype(np.float64)
        base = float((query * ends).sum())
        slack = 1e-9 * (abs(base) + best) + 1.0
        top = impact.max(axis=1, initial=0)

        flat = impact.ravel()
        ranked = np.argsort(-flat, kind="stable")
        ranked = ranked[flat[ranked] > 0]
        done = np.cumsum(self._sizes.ravel()[ranked])
        sums, met = np.zeros(rows, np.int64), np.zeros(rows, np.int16)
        taken = np.zeros(width, np.int64)  # postings of each dimension already added
        alive = np.arange(rows)
        for wave in WAVES:
            upto = int(np.searchsorted(done, wave * width * rows)) + 1
            t = int(flat[ranked[upto]]) if upto < len(ranked) else 0
            for d in np.flatnonzero(top > t).tolist():
                # Segments above t stand at one end of the dimension's order.
                want = int(self._sizes[d][impact[d] > t].sum())
                have = int(taken[d])
                if want == have:
                    continue
                piece = slice(rows - want, rows - have) if rising[d] else slice(have, want)
                at = shard.order[d, piece]
                sums[at] += impact[d][self._levels[d, piece]]
                met[at] += 1
                taken[d] = want
            bound = base + unit * (float(np.minimum(top, t).sum()) + sums - np.float64(t) * met) + slack
            if floor is None:
                likely = np.argpartition(-bound, min(4 * k, rows - 1))[: 4 * k] if rows > 4 * k else alive
                likely = likely[shard.ids[likely] != own]
                if len(likely) >= k:
                    floor = int(np.partition(_exact(shard.vectors[likely], query), -k)[-k])
            if floor is not None:
                alive = np.flatnonzero(bound >= floor)
                if len(alive) <= RESCORE_SHARE * rows:
                    break
        return alive

    def best(self, query: np.ndarray, own: int, k: int, scores: np.ndarray, ids: np.ndarray):
        """The best ``k`` of the given (scores, ids) and this shard's rows for one query."""
        width = self.shard.vectors.shape[1]
        part = np.zeros(width, np.int64)
        part[: min(width, len(query))] = query[:width]
        floor = int(scores[-1]) if len(scores) == k else None
        if width:
            alive = self.possible(part, k, floor, own)
            alive = alive[self.shard.ids[alive] != own]
            exact = _exact(self.shard.vectors[alive], part)
        else:
            alive = np.flatnonzero(self.shard.ids != own)
            exact = np.zeros(len(alive), np.int64)
        if floor is not None:
            keep = exact >= floor
            alive, exact = alive[keep], exact[keep]
        return _first(np.concatenate([scores, exact]), np.concatenate([ids, self.shard.ids[alive]]), k)


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest scores, ties to the smaller id."""
    if len(scores) > 8 * k:
        some = scores >= np.partition(scores, -k)[-k]
        scores, ids = scores[some], ids[some]
    order = np.lexsort((ids, ~scores))[:k]
    return scores[order], ids[order]


_PACKED = "block int, part int, counts binary, scores binary, ids binary"


def _pack(block: int, part: int, best: list) -> pa.RecordBatch:
    counts = np.array([len(s) for s, _ in best], np.int32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block], pa.int32()),
            pa.array([part], pa.int32()),
            pa.array([counts.tobytes()], pa.binary()),
            pa.array([np.concatenate([s for s, _ in best]).tobytes()], pa.binary()),
            pa.array([np.concatenate([i for _, i in best]).tobytes()], pa.binary()),
        ],
        ["block", "part", "counts", "scores", "ids"],
    )


def _unpack(row: dict) -> list:
    cuts = np.cumsum(np.frombuffer(row["counts"], np.int32))[:-1]
    return list(
        zip(
            np.split(np.frombuffer(row["scores"], np.int64), cuts),
            np.split(np.frombuffer(row["ids"], np.int64), cuts),
            strict=True,
        )
    )


def _search_block(index: DataFrame, block: int, own: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """Packed best ``k`` of one block of queries, a row a task of the index."""
    shared = index.sparkSession.sparkContext.broadcast((own, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        none = np.zeros(0, np.int64)
        best = [(none, none)] * len(ids)
        seen = False
        for batch in batches:
            for at in range(batch.num_rows):
                searcher = Searcher(_unpacked({c: batch.column(c)[at].as_py() for c in batch.schema.names}))
                seen = True
                for i, one in enumerate(ids.tolist()):
                    best[i] = searcher.best(vectors[i], one, k, *best[i])
        if seen:
            yield _pack(block, TaskContext.get().partitionId(), best)

    return map_batches(index, run, _PACKED)


def _merged(packed: DataFrame, k: int) -> DataFrame:
    """One packed row a block, by rounds over ``FAN_IN`` parts of it."""

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        best = None
        for row in rows.select(["counts", "scores", "ids"]).to_pylist():
            more = _unpack(row)
            if best is None:
                best = more
            else:
                best = [
                    _first(np.concatenate([a, c]), np.concatenate([b, d]), k)
                    for (a, b), (c, d) in zip(best, more, strict=True)
                ]
        return pa.Table.from_batches([_pack(key[0].as_py(), key[1].as_py(), best)])

    last = packed.agg(F.max("part")).first()[0] or 0
    while last:
        last //= FAN_IN
        packed = (
            packed.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
            .groupBy("block", "part")
            .applyInArrow(merge, _PACKED)
        )
    return packed


def search(
    index: DataFrame,
    queries: DataFrame,
    id_col: str,
    vector_col: str,
    k: int = 10,
    scale: int = 1024,
    block_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank (from 1), id, score: the ``k`` best rows of the index for each query."""
    spark = index.sparkSession
    asked = _narrow(queries, id_col, vector_col).distinct()
    total, width = asked.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    width = width or 0
    rows = max(1, min(block_rows, QUERY_BYTES // max(8 * width, 1)))
    blocks = -(-total // rows)
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(max(blocks, 1))))
    parts, own = [], {}
    for block in range(blocks):
        table = dealt.filter(F.col("block") == block).drop("block").toArrow().combine_chunks()
        if not table.num_rows:
            continue
        own[block] = table.column("id").to_numpy()
        vectors = scaled(table.column("vector").chunk(0), width, scale)
        found = stored(_search_block(index, block, own[block], vectors, k), "top-k")
        named = _named(_merged(found, k), own[block], spark)
        parts.append(stored(named, "top-k") if blocks > 1 else named)
    empty = "query_id bigint, rank int, id bigint, score bigint"
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], empty)


def _named(merged: DataFrame, own: np.ndarray, spark) -> DataFrame:
    shared = spark.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                best = _unpack(row)
                counts = np.array([len(s) for s, _ in best])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(shared.value, counts), pa.int64()),
                        pa.array(np.concatenate([np.arange(1, n + 1) for n in counts]), pa.int32()),
                        pa.array(np.concatenate([i for _, i in best]), pa.int64()),
                        pa.array(np.concatenate([s for s, _ in best]), pa.int64()),
                    ],
                    ["query_id", "rank", "id", "score"],
                )

    return map_batches(merged, run, "query_id bigint, rank int, id bigint, score bigint")
