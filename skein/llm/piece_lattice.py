"""SentencePiece-style encoding and decoding over a lattice of pieces.

A text is cut into units: a run of letters, digits or other characters
(underscores and superscript two among them), each with all blanks before it, a
run of blanks, or a line break.  No piece of the table crosses a unit, which
loading the table checks, so the best path of a text is the best paths of its
units one after the other.  The lattice of a table of distinct units
is relational: substrings of at most ``MAX_PIECE`` characters are exploded,
equi-joined to the piece table on their text, and the edges of a unit grouped
by where they end; a Viterbi fold over its end positions picks the path with
the best sum of piece scores.  A character that is no piece becomes the byte
pieces of its UTF-8 form, so decoding gives back every text exactly.

``encode_units`` is that plan in DataFrame functions, for a table of units.
Documents go through ``encode``: joining 130 million unit occurrences back to
their documents would shuffle several times the text, so there the same
explode, join, group and fold run on the distinct units of an Arrow batch, as
array operations, with a bounded memo of the units a worker has met.

The public model file is a merge model: its scores are negative merge ranks.
They are read as Zipf log-probabilities, ``-ln(rank + 1)``.  Ties take the
shorter last piece.

Null and empty texts give no ids and decode to the empty text.  Repeated rows
repeat; only the id and text columns are read.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import map_batches
from skein.llm.textbytes import mix, prefix_hashes, span_hashes

MAX_PIECE = 16
BLANK = "▁"
#: Stands for a blank mark that the text itself holds; no piece has it.
LITERAL = 0x110000
UNITS = re.compile(r" *(?:[^\W\d_²]+|\d+|(?:[_²]|[^\w \n])+)| +|\n")
MEMO_UNITS = 400_000
BATCH_UNITS = 50_000
#: Fewer units of a length than this are folded one by one, which is faster than short arrays.
FEW_LIVE = 8


class Pieces(NamedTuple):
    """The piece table of a model file."""

    texts: list[str]
    scores: np.ndarray
    byte_ids: np.ndarray
    kinds: list[str]  # normal, byte, control

    @property
    def fallback(self) -> float:
        """Score of a character that is no piece; below every piece's."""
        return float(self.scores.min()) - 10.0


@functools.cache
def load_pieces(path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    kinds = [
        "byte" if model.is_byte(i) else "control" if model.is_control(i) or model.is_unknown(i) else "normal"
        for i in range(n)
    ]
    scores = np.array([-math.log(1.0 - min(0.0, model.get_score(i))) for i in range(n)])
    texts = [model.id_to_piece(i) for i in range(n)]
    crossing = [t for t, k in zip(texts, kinds, strict=True) if k == "normal" and len(UNITS.findall(t.replace(BLANK, " "))) > 1]
    if crossing:
        raise ValueError(f"pieces that cross units: {crossing[:5]}")
    byte_ids = np.zeros(256, np.int64)
    for i, kind in enumerate(kinds):
        if kind == "byte":
            byte_ids[int(texts[i][3:5], 16)] = i
    return Pieces(texts, scores, byte_ids, kinds)


def units_of(text: str) -> list[str]:
    """Units of a text behind its dummy blank; the concatenation is ``' ' + text``."""
    return UNITS.findall(" " + text) if text else []


# --- the plan over a table of units -------------------------------------------------------------------


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(piece, id, score) of the pieces a text can match; as long as the model file says."""
    pieces = load_pieces(path)
    rows = [
        (t, i, float(s))
        for i, (t, s, k) in enumerate(zip(pieces.texts, pieces.scores, pieces.kinds, strict=True))
        if k == "normal" and len(t) <= MAX_PIECE
    ]
    return spark.createDataFrame(rows, "piece string, id int, score double")


def encode_units(units: DataFrame, path: str) -> DataFrame:
    """(unit, ids) of a table of distinct units: explode, equi-join, group by unit, fold."""
    pieces = load_pieces(path)
    table = piece_table(units.sparkSession, path)
    marked = F.replace(F.replace("unit", F.lit(BLANK), F.lit("﷐")), F.lit(" "), F.lit(BLANK))
    cut = units.select("unit", marked.alias("marked")).withColumn("n", F.length("marked"))
    spots = cut.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    longest = F.least(F.lit(MAX_PIECE), F.col("n") - F.col("start"))
    parts = spots.withColumn("size", F.explode(F.sequence(F.lit(1), longest))).select(
        "unit", "n", "start", "size", F.expr("substring(marked, start + 1, size)").alias("piece")
    )
    # Every single character has an edge: its piece or, failing that, its bytes (id -1).
    edges = parts.join(table, "piece", "left").filter(F.col("id").isNotNull() | (F.col("size") == 1))
    edges = edges.select(
        "unit",
        "n",
        (F.col("start") + F.col("size")).alias("end"),
        F.struct(
            "size",
            F.coalesce("id", F.lit(-1)).alias("id"),
            F.coalesce("score", F.lit(pieces.fallback)).alias("score"),
            F.when(F.col("id").isNull(), F.expr("substring(unit, start + 1, 1)")).alias("raw"),
        ).alias("edge"),
    )
    by_end = edges.groupBy("unit", "n", "end").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    by_unit = by_end.groupBy("unit", "n").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("end", "edges"))), lambda x: x["edges"]).alias("ends")
    )
    step = "struct<score:double,path:array<struct<id:int,raw:string>>>"
    start = F.array(F.expr(f"cast(named_struct('score', 0D, 'path', array()) as {step})"))

    def fold(best, edges):
        options = F.transform(
            edges,
            lambda e: F.struct(
                (F.element_at(best, -e["size"])["score"] + e["score"]).alias("score"),
                F.concat(
                    F.element_at(best, -e["size"])["path"],
                    F.array(F.struct(e["id"].alias("id"), e["raw"].alias("raw"))),
                ).alias("path"),
            ),
        )
        chosen = F.reduce(
            F.slice(options, 2, F.size(options)),
            F.element_at(options, 1),
            lambda a, b: F.when(b["score"] > a["score"], b).otherwise(a),
        )
        return F.concat(best, F.array(chosen))

    path_ = F.element_at(F.aggregate("ends", start, fold), -1)["path"]
    bytes_of = F.array(*[F.lit(int(i)) for i in pieces.byte_ids])
    ids = F.flatten(
        F.transform(
            path_,
            lambda p: F.when(p["id"] >= 0, F.array(p["id"])).otherwise(
                F.transform(
                    F.filter(F.split(F.regexp_replace(F.hex(F.encode(p["raw"], "UTF-8")), "(..)", "$1,"), ","), lambda h: h != ""),
                    lambda h: F.element_at(bytes_of, F.conv(h, 16, 10).cast("int") + 1),
                )
            ),
        )
    )
    return by_unit.select("unit", ids.alias("ids"))


# --- the same steps on the distinct units of a batch --------------------------------------------------


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


@functools.cache
def _by_length(path: str) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: sorted hashes of the pieces, their ids, their code points."""
    pieces = load_pieces(path)
    out = []
    for size in range(1, MAX_PIECE + 1):
        ids = np.array(
            [i for i, (t, k) in enumerate(zip(pieces.texts, pieces.kinds, strict=True)) if k == "normal" and len(t) == size],
            np.int64,
        )
        flat = _code_points("".join(pieces.texts[i] for i in ids)).astype(np.int64)
        starts = np.arange(len(ids)) * size
        hashes = mix(span_hashes(prefix_hashes(flat), starts, starts + size))
        order = np.argsort(hashes)
        out.append((hashes[order], ids[order], flat.reshape(-1, size)[order]))
    return out


def _edges(path: str, points: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Per length and start: the id of the piece there, or -1; ``ends``: where a start's unit ends."""
    prefix = prefix_hashes(points)
    found = []
    for size, (hashes, ids, spelled) in enumerate(_by_length(path), 1):
        piece = np.full(len(points), -1, np.int64)
        starts = np.flatnonzero(np.arange(len(points)) + size <= ends)
        if len(starts) and len(hashes):
            h = mix(span_hashes(prefix, starts, starts + size))
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = np.flatnonzero(hashes[place] == h)
            same = (points[starts[hit][:, None] + np.arange(size)] == spelled[place[hit]]).all(axis=1)
            piece[starts[hit[same]]] = ids[place[hit[same]]]
        found.append(piece)
    return found


def segment(path: str, units: list[str]) -> list[bytes]:
    """Little-endian 32-bit ids of each unit: the best path through its lattice."""
    pieces = load_pieces(path)
    fallback = pieces.fallback
    order = sorted(range(len(units)), key=lambda i: -len(units[i]))
    lengths = np.array([len(units[i]) for i in order], np.int64)
    points = _code_points("".join(units[i] for i in order)).astype(np.int64)
    points = np.where(points == ord(BLANK), LITERAL, np.where(points == 32, ord(BLANK), points))
    heads = np.cumsum(lengths) - lengths
    edges = _edges(path, points, np.repeat(heads + lengths, lengths))
    # best[p]: score of the best path that ends before p; one slot more for each unit's end.
    slot = heads + np.arange(len(units))
    best = np.full(len(points) + len(units), -np.inf)
    back = np.zeros(len(points) + len(units), np.int64)
    best[slot] = 0.0
    for end in range(1, int(lengths[0]) + 1 if len(lengths) else 0):
        live = int(np.searchsorted(-lengths, -end, "right"))
        if live < FEW_LIVE:
            for unit in range(live):
                at, head, top = int(slot[unit]) + end, int(heads[unit]) + end, -np.inf
                for size in range(1, min(MAX_PIECE, end) + 1):
                    piece = edges[size - 1][head - size]
                    if piece >= 0 or size == 1:
                        total = best[at - size] + (pieces.scores[piece] if piece >= 0 else fallback)
                        if total > top:
                            top, back[at] = total, size
                best[at] = top
            continue
        for size in range(1, min(MAX_PIECE, end) + 1):
            piece = edges[size - 1][heads[:live] + end - size]
            score = np.where(piece >= 0, pieces.scores[piece], fallback if size == 1 else -np.inf)
            total = best[slot[:live] + end - size] + score
            better = total > best[slot[:live] + end]
            at = slot[:live][better] + end
            best[at] = total[better]
            back[at] = size
    out: list[bytes] = [b""] * len(units)
    for i, unit in enumerate(order):
        path_ids: list[int] = []
        end = int(lengths[i])
        while end:
            size = int(back[slot[i] + end])
            start = int(heads[i]) + end - size
            piece = int(edges[size - 1][start])
            if piece >= 0:
                path_ids.append(piece)
            else:
                raw = units[unit][end - 1].encode("utf-8", "surrogatepass")
                path_ids += [int(pieces.byte_ids[b]) for b in reversed(raw)]
            end -= size
        out[unit] = np.array(path_ids[::-1], "<i4").tobytes()
    return out


_memo: dict[str, bytes] = {}


def encode_texts(path: str, texts: list[str]) -> list[bytes]:
    """Little-endian 32-bit ids of each text."""
    cut = [units_of(t) for t in texts]
    fresh = list({u for units in cut for u in units if u not in _memo})
    if len(_memo) + len(fresh) > MEMO_UNITS:
        _memo.clear()
        fresh = list({u for units in cut for u in units})
    for at in range(0, len(fresh), BATCH_UNITS):
        part = fresh[at : at + BATCH_UNITS]
        _memo.update(zip(part, segment(path, part), strict=True))
    return [b"".join(map(_memo.__getitem__, units)) for units in cut]


@functools.cache
def _spelling(path: str) -> list[bytes]:
    """Bytes of each id."""
    pieces = load_pieces(path)
    return [
        bytes([int(t[3:5], 16)]) if k == "byte" else b"" if k == "control" else t.replace(BLANK, " ").encode()
        for t, k in zip(pieces.texts, pieces.kinds, strict=True)
    ]


def decode_ids(path: str, ids: list[int]) -> str:
    spelling = _spelling(path)
    return b"".join([spelling[i] for i in ids])[1:].decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``ids`` of every row."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = encode_texts(path, [t or "" for t in batch.column("text").to_pylist()])
            ends = np.cumsum([0, *(len(c) // 4 for c in coded)]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(coded), "<i4"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "ids"]
            )

    id_type = dict(narrow.dtypes)["doc_id"]
    return map_batches(narrow, run, f"doc_id {id_type}, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and ``text`` of an encoded table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(path, ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())],
                ["doc_id", "ids", "text"],
            )

    narrow = coded.select("doc_id", "ids")
    return map_batches(narrow, run, f"doc_id {dict(narrow.dtypes)['doc_id']}, ids array<int>, text string")


def round_trip(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of little-endian 32-bit ids), whether decoding gives the text back, the ids."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "n_tokens", "ids_crc32", "round_trip", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            coded = encode_texts(path, texts)
            ids = [np.frombuffer(c, "<i4") for c in coded]
            back = [decode_ids(path, i.tolist()) == t for i, t in zip(ids, texts, strict=True)]
            columns = [
                batch.column("doc_id"),
                pa.array([len(i) for i in ids], pa.int64()),
                pa.array([zlib.crc32(c) for c in coded], pa.int64()),
                pa.array(back, pa.bool_()),
            ]
            if with_ids:
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), "<i4"))))
            yield pa.RecordBatch.from_arrays(columns, names)

    id_type = dict(narrow.dtypes)["doc_id"]
    schema = f"doc_id {id_type}, n_tokens bigint, ids_crc32 bigint, round_trip boolean"
    return map_batches(narrow, run, schema + (", ids array<int>" if with_ids else ""))
