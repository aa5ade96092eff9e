"""Token-id files with Elias-Fano document boundaries.

A file row holds the concatenated ids of a run of documents in ascending
doc_id order, and the cumulative document ends as an Elias-Fano sequence: the
low bits packed, the high bits in unary, and a sample of where every
``SAMPLE``-th one-bit stands, so that ``select`` touches one short stretch.
About ``2 + log2(ids / documents)`` bits a boundary replace a 64-bit offset
table.  Spark writes the rows as a Parquet table of binary columns, so any
store it can write to will do and a lost task is written again.

Documents are dealt by ranges of doc_id; inside a partition a row is closed
when ``row_ids`` ids are gathered, so memory is bounded by that and by the
longest single document.  Null and empty texts hold the end id alone.  Equal
doc_ids are ordered by text (nulls first).
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import map_batches

SAMPLE = 64
ROW_IDS = 2_000_000
CACHE_PARTS = 500_000

Encoder = Callable[[list[str]], list[list[int]]]


class EliasFano(NamedTuple):
    """A non-decreasing sequence of ``count`` numbers below ``universe``."""

    count: int
    universe: int
    low: bytes
    high: bytes
    samples: bytes

    @property
    def low_bits(self) -> int:
        return low_bits(self.count, self.universe)


def low_bits(count: int, universe: int) -> int:
    return max(0, (universe // count).bit_length() - 1) if count else 0


def ef_encode(values: np.ndarray, universe: int) -> EliasFano:
    """``values``: non-decreasing, at least 0 and at most ``universe``."""
    n = len(values)
    width = low_bits(n, universe)
    values = values.astype(np.int64)
    low = ((values[:, None] >> np.arange(width)) & 1).astype(np.uint8).ravel()
    ones = (values >> width) + np.arange(n)
    high = np.zeros((universe >> width) + n + 1, np.uint8)
    high[ones] = 1
    return EliasFano(
        n,
        universe,
        np.packbits(low, bitorder="little").tobytes(),
        np.packbits(high, bitorder="little").tobytes(),
        ones[::SAMPLE].astype("<u4").tobytes(),
    )


def ef_select(seq: EliasFano, index: int) -> int:
    """The ``index``-th number, from its select sample on."""
    if not 0 <= index < seq.count:
        raise IndexError(index)
    sample = int(np.frombuffer(seq.samples, "<u4")[index // SAMPLE])
    left = index % SAMPLE
    high = np.frombuffer(seq.high, np.uint8)
    byte, width = sample >> 3, seq.low_bits
    window = np.unpackbits(high[byte : byte + 1], bitorder="little")
    window[: sample & 7] = 0
    while (have := int(window.sum())) <= left:  # byte by byte until enough ones are passed
        left -= have
        byte += 1
        window = np.unpackbits(high[byte : byte + 1], bitorder="little")
    one = byte * 8 + int(np.flatnonzero(window)[left])
    first = index * width
    bits = np.unpackbits(
        np.frombuffer(seq.low, np.uint8)[first >> 3 : (first + width + 7) >> 3], bitorder="little"
    )[first & 7 : (first & 7) + width]
    low = int(bits.astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))) if width else 0
    return ((one - index) << width) | low


def ef_decode(seq: EliasFano) -> np.ndarray:
    """All numbers of the sequence."""
    width, n = seq.low_bits, seq.count
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(seq.high, np.uint8), bitorder="little"))[:n]
    high = (ones - np.arange(n)) << width
    if not width:
        return high
    bits = np.unpackbits(np.frombuffer(seq.low, np.uint8), bitorder="little")[: n * width].reshape(n, width)
    return high | (bits.astype(np.int64) @ (1 << np.arange(width, dtype=np.int64)))


@functools.cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# The tokenizer's own pre-tokens, over lower-cased Latin-1 text: letters, numbers and white space
# of that range written out.  Fixed values: the contractions come from the tokenizer file.
_LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = "\t-\r \x85\xa0"
_PRETOKEN = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_LETTER}{_NUMBER}{_SPACE}]+"
)
_SPACES = re.compile("[\t-\r ]+")
_memo: dict[str, bytes] = {}


@functools.cache
def _pretoken_ends(path: str) -> np.ndarray:
    """By id: whether the token ends a pre-token."""
    vocabulary = _tokenizer(path).get_vocab(with_added_tokens=True)
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
    return ends


def _parts(text: str) -> list[str]:
    """Parts whose ids, one after the other, are the text's ids.

    For text in Latin-1 these are the tokenizer's pre-tokens; its normalizer
    only lower-cases there.  Other text, and text that spells a special token,
    is cut at ASCII white space, which the tokenizer drops and never merges
    across; those parts are marked by a leading blank.
    """
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        plain = False
    else:
        plain = "<|" not in text
    if plain:
        return _PRETOKEN.findall(text.lower())
    return [f" {w}" for w in _SPACES.split(text) if w]


def encode_texts(path: str, texts: list[str], dtype: str) -> list[bytes]:
    """Ids of each text by the tokenizer file at ``path``, as little-endian bytes.

    Parts already seen by this worker come from a memo that is cleared when it is full.  A text
    is looked up while its parts are fresh in the processor's cache, once; those with parts that
    the memo lacks wait until the new parts of all texts are learnt.
    """
    out: list[bytes] = []
    waiting: list[tuple[int, list[str], list[bytes | None]]] = []
    fresh: set[str] = set()
    for text in texts:
        parts = _parts(text)
        codes = list(map(_memo.get, parts))
        try:
            out.append(b"".join(codes))
        except TypeError:  # a None among them
            fresh.update([w for w, code in zip(parts, codes, strict=True) if code is None])
            waiting.append((len(out), parts, codes))
            out.append(b"")
    if len(_memo) + len(fresh) > CACHE_PARTS:
        _memo.clear()
    _learn(path, sorted(fresh), dtype)
    for at, parts, codes in waiting:
        out[at] = b"".join([_memo[w] if code is None else code for w, code in zip(parts, codes, strict=True)])
    return out


def _learn(path: str, fresh: list[str], dtype: str) -> None:
    """Encode new parts: pre-tokens many at a time, told apart by their end tokens."""
    tokenizer, ends = _tokenizer(path), _pretoken_ends(path)
    whole = [w for w in fresh if w[0] == " "]
    single = [w for w in fresh if w[0] != " "]
    for at in range(0, len(single), 2_000):
        chunk = single[at : at + 2_000]
        ids = np.array(tokenizer.encode(" ".join(chunk), add_special_tokens=False).ids, np.int64)
        stops = np.flatnonzero(ends[ids]) + 1
        if len(stops) != len(chunk) or stops[-1] != len(ids):
            whole += [w for w in chunk]
            continue
        raw, size = ids.astype(dtype).tobytes(), np.dtype(dtype).itemsize
        edges = [0, *(stops * size).tolist()]
        _memo.update((w, raw[s:e]) for w, s, e in zip(chunk, edges, edges[1:], strict=False))
    for at in range(0, len(whole), 10_000):
        chunk = whole[at : at + 10_000]
        for word, code in zip(chunk, tokenizer.encode_batch(chunk, add_special_tokens=False), strict=True):
            _memo[word] = np.array(code.ids, dtype).tobytes()


FILE_SCHEMA = (
    "part int, row int, id_bytes int, ids binary, doc_ids array<bigint>, n_ids bigint, n_docs bigint,"
    " ef_low binary, ef_high binary, ef_samples binary"
)


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int,
    partitions: int | None = None,
    row_ids: int = ROW_IDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode every text and write the id files to ``path`` in ascending doc_id order."""
    spark = docs.sparkSession
    if partitions is None:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = narrow.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id", "text")
    wide = _vocabulary_top(tokenizer_path, end_id) > 0xFFFF
    dtype = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tail = np.array([end_id], dtype).tobytes()
        runs: list[bytes] = []
        doc_ids: list[int | None] = []
        ends: list[int] = []
        total = row = 0

        def close() -> pa.RecordBatch:
            seq = ef_encode(np.array(ends), total)
            columns = {
                "part": pa.array([part], pa.int32()),
                "row": pa.array([row], pa.int32()),
                "id_bytes": pa.array([4 if wide else 2], pa.int32()),
                "ids": pa.array([b"".join(runs)], pa.binary()),
                "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
                "n_ids": pa.array([total], pa.int64()),
                "n_docs": pa.array([len(ends)], pa.int64()),
                "ef_low": pa.array([seq.low], pa.binary()),
                "ef_high": pa.array([seq.high], pa.binary()),
                "ef_samples": pa.array([seq.samples], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, ids in zip(
                batch.column("doc_id").to_pylist(), encode_texts(tokenizer_path, texts, dtype), strict=True
            ):
                n = len(ids) // len(tail) + 1
                if ends and total + n > row_ids:
                    yield close()
                    runs, doc_ids, ends, total, row = [], [], [], 0, row + 1
                runs += [ids, tail]
                total += n
                ends.append(total)
                doc_ids.append(doc)
        if ends:
            yield close()

    map_batches(ordered, run, FILE_SCHEMA).write.parquet(path)


def _vocabulary_top(path: str, end_id: int) -> int:
    return max(end_id, *_tokenizer(path).get_vocab(with_added_tokens=True).values())


def read_token_files(spark, path: str) -> DataFrame:
    """Per document: doc_id, start (ids before it), n_tokens, ids_crc32, ids (binary, little-endian)."""
    files = spark.read.parquet(path)
    # Offsets of file rows: sums inside a partition's rows, then over partitions.
    sizes = files.select("part", "row", "n_ids")
    inner = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    outer = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_base"))
    offsets = sizes.join(bases, "part").select(
        "part", "row", (F.col("_base") + F.coalesce(F.sum("n_ids").over(inner), F.lit(0))).alias("first")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                r = {k: batch.column(k)[at].as_py() for k in batch.schema.names}
                ends = ef_decode(EliasFano(r["n_docs"], r["n_ids"], r["ef_low"], r["ef_high"], r["ef_samples"]))
                starts = np.concatenate([[0], ends[:-1]])
                ids = np.frombuffer(r["ids"], "<u2" if r["id_bytes"] == 2 else "<u4").astype("<u4")
                raw = memoryview(ids).cast("B")
                sums = [
                    zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)
                ]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, r["part"]), pa.int32()),
                        pa.array(np.full(n, r["row"]), pa.int32()),
                        pa.array(r["doc_ids"], pa.int64()),
                        pa.array(starts, pa.int64()),
                        pa.array(ends - starts, pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    ["part", "row", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    rows = map_batches(
        files, run, "part int, row int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return rows.join(offsets, ["part", "row"]).select(
        "doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )
