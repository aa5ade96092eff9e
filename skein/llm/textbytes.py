"""Words and hashes of whole Arrow text columns, by numpy over their bytes.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z is lower-cased.
Every byte of a non-ASCII character is above 0x7F, so the runs can be found on
bytes.  Hashes are polynomial prefix hashes modulo 2**64: equal strings have
equal hashes; whoever needs certainty compares the bytes afterwards.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True

BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i < n."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        grown = np.full(max(n, 1 << 16), base, np.uint64)
        grown[0] = 1
        _POWERS[base] = have = np.cumprod(grown, dtype=np.uint64)
    return have[:n]


INVERSE = pow(BASE, -1, 1 << 64)


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """h[i]: sum of (values[j] + 1) * BASE**j over j < i."""
    out = np.zeros(len(values) + 1, np.uint64)
    terms = values.astype(np.uint64)
    terms += np.uint64(1)
    terms *= powers(len(values))
    np.cumsum(terms, out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] that does not depend on where the span stands."""
    return (prefix[ends] - prefix[starts]) * powers(len(prefix), INVERSE)[starts]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows and the row offsets; a null row is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words(NamedTuple):
    """All words of a column: lower-cased bytes, word byte ranges, first word of each row, hashes."""

    lower: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def row_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, word, "right") - 1


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    lower = LOWER[data]
    inside = WORD_BYTE[lower]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    opens[heads] = inside[heads]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    closes[tails] = inside[tails]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashes = mix(span_hashes(prefix_hashes(lower), starts, ends) + (ends - starts).astype(np.uint64))
    return Words(lower, starts, ends, np.searchsorted(starts, offsets), hashes)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``size`` words; a shorter row with words is one shingle."""
    n = len(words.hashes)
    counts = np.diff(words.first)
    rows = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - words.first[rows]
    starts = np.flatnonzero(place + size <= counts[rows])
    folded = np.zeros(len(starts), np.uint64)
    for j in range(size):
        folded = folded * np.uint64(BASE) + words.hashes[starts + j]
    short = np.flatnonzero((counts > 0) & (counts < size))
    whole = np.zeros(len(short), np.uint64)
    for j in range(size):
        have = counts[short] > j
        at = np.minimum(words.first[short] + j, max(n - 1, 0))
        whole = np.where(have, whole * np.uint64(BASE) + words.hashes[at] if n else whole, whole)
    row = np.concatenate([rows[starts], short])
    order = np.argsort(row, kind="stable")
    return row[order], mix(np.concatenate([folded, whole]))[order]
