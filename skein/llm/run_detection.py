"""Periodic runs of words by a suffix automaton with link-cut access.

Words ``[^\\x20\\x09-\\x0D]+`` of a text are appended one by one to a suffix
automaton.  The suffix-link tree is held as a link-cut tree whose preferred
paths are coloured with the last word at which their states ended.  Appending
word i accesses the state of the new prefix: every path segment met on the way
to the root carries one earlier end j, and the deepest state of the segment
has length L.  Where i - j <= L, the factor of length i - j ends at i and at
j, so a square of period i - j ends at i; as j is the *last* earlier end, the
period is the smallest one.  Each such square is extended to its run.  Every
run of exponent 2 or more is met, at every word from its second period on.

Before that, words that cannot lie in a run asked for are set aside: a run of
at least ``least`` words and three periods is covered by word windows that
occur at least twice in it, so only stretches of windows repeated within the
text go to the automaton, and windows are counted again inside each stretch
until nothing changes.  Window hashes only ever keep too much.

A batch holds whole documents; nothing is exchanged between tasks.  Memory is
that of the longest single text and its automaton.  Null and empty texts, and
texts of blanks, have no words: no runs, four nulls, and the hash of nothing.
Repeated rows and equal ids are reported row by row; an empty table gives an
empty one; other columns are not looked at.  With ``planted`` (the query), a
document whose id hash says so has its tail replaced by a repetition first; a
null id has no hash and is left as it is.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import map_batches
from skein.llm.textbytes import BASE, mix

LEAST_WORDS, LEAST_PERIODS = 24, 3
_SLOTS = 1 << 22


class Run(NamedTuple):
    start: int
    length: int
    period: int


class SuffixAutomaton:
    """Suffix automaton of a growing sequence; ``append`` returns the squares that end there.

    State 1 is the root and 0 stands for none.  ``_up`` is the parent inside
    a splay tree, or at its root the state the preferred path hangs from; the
    last end of a path is kept at the root of its splay tree.
    """

    def __init__(self) -> None:
        self._length, self._link = [0, 0], [0, 0]
        self._key, self._to = [-1, -1], [0, 0]
        self._more: dict[int, dict[int, int]] = {}
        self._left, self._right, self._up, self._end = [0, 0], [0, 0], [0, 0], [-1, -1]
        self._last = 1
        self._size = 0

    def _state(self, length: int, link: int) -> int:
        for column, value in (
            (self._length, length),
            (self._link, link),
            (self._key, -1),
            (self._to, 0),
            (self._left, 0),
            (self._right, 0),
            (self._up, link),
            (self._end, -1),
        ):
            column.append(value)
        return len(self._length) - 1

    def _step(self, state: int, symbol: int) -> int:
        if self._key[state] == symbol:
            return self._to[state]
        more = self._more.get(state)
        return more.get(symbol, 0) if more else 0

    def _set(self, state: int, symbol: int, target: int) -> None:
        if self._key[state] in (-1, symbol):
            self._key[state], self._to[state] = symbol, target
        else:
            self._more.setdefault(state, {})[symbol] = target

    def _clone(self, state: int, length: int) -> int:
        """A state for the shorter words of ``state``: above it on the same path, with the same last end."""
        twin = self._state(length, self._link[state])
        self._key[twin], self._to[twin] = self._key[state], self._to[state]
        if state in self._more:
            self._more[twin] = dict(self._more[state])
        self._splay(state)
        above = self._left[state]
        self._left[twin] = above
        if above:
            self._up[above] = twin
        self._left[state], self._up[twin] = twin, state
        self._link[state] = twin
        return twin

    def _splay(self, x: int) -> None:
        left, right, up = self._left, self._right, self._up
        y = up[x]
        while y and (left[y] == x or right[y] == x):
            z = up[y]
            inner = z and (left[z] == y or right[z] == y)
            if inner:
                # Two steps: the parent first where both lean the same way, else x twice.
                turns = (y, x) if (left[z] == y) == (left[y] == x) else (x, x)
            else:
                self._end[x] = self._end[y]
                turns = (x,)
            for t in turns:
                p = up[t]
                g = up[p]
                if left[p] == t:
                    b = right[t]
                    left[p], right[t] = b, p
                else:
                    b = left[t]
                    right[p], left[t] = b, p
                if b:
                    up[b] = p
                up[t], up[p] = g, t
                if g:
                    if left[g] == p:
                        left[g] = t
                    elif right[g] == p:
                        right[g] = t
            if inner:
                g = up[x]
                if not (g and (left[g] == x or right[g] == x)):
                    self._end[x] = self._end[z]
            y = up[x]

    def _extend(self, symbol: int) -> int:
        state = self._state(self._size + 1, 1)
        p, length, link = self._last, self._length, self._link
        while p and not (q := self._step(p, symbol)):
            self._set(p, symbol, state)
            p = link[p]
        if p:
            if length[q] != length[p] + 1:
                twin = self._clone(q, length[p] + 1)
                while p and self._step(p, symbol) == q:
                    self._set(p, symbol, twin)
                    p = link[p]
                q = twin
            link[state] = self._up[state] = q
        self._last = state
        return state

    def append(self, symbol: int) -> list[tuple[int, int]]:
        """(period, length of the repeated factor) of the squares found at the new end, by segment."""
        x, below, at = self._extend(symbol), 0, self._size
        self._size += 1
        squares = []
        right, end, length = self._right, self._end, self._length
        while x:
            self._splay(x)
            before = end[x]
            if before >= 0 and at - before <= length[x]:
                squares.append((at - before, length[x]))
            cut = right[x]
            if cut:
                end[cut] = before
            right[x] = below
            below, x = x, self._up[x]
        end[below] = at
        return squares


def runs_of(symbols: list[int], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[Run]:
    """All maximal runs of at least ``least`` symbols and ``periods`` periods, by start then period."""
    automaton, known, found = SuffixAutomaton(), {}, []
    n = len(symbols)
    for at, symbol in enumerate(symbols):
        for period, length in automaton.append(symbol):
            if known.get(period, -1) >= at:
                continue
            end = at + 1
            while end < n and symbols[end] == symbols[end - period]:
                end += 1
            known[period] = end - 1
            start = at + 1 - length - period
            while start > 0 and symbols[start - 1] == symbols[start - 1 + period]:
                start -= 1
            if end - start >= max(least, periods * period):
                found.append(Run(start, end - start, period))
    return sorted(found, key=lambda r: (r.start, r.period))


def _repeated_stretches(codes: np.ndarray, cuts: np.ndarray, window: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Word ranges of stretches whose every ``window`` occurs twice or more in its own part of ``cuts``."""
    starts = len(codes) - window + 1
    if starts <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    part = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    key = np.zeros(starts, np.uint64)
    for j in range(window):
        key = key * np.uint64(BASE) + codes[j : starts + j].astype(np.uint64)
    whole = part[:starts] == part[window - 1 :]
    key = mix(key + part[:starts].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    ordered = np.sort(key[whole])
    twice = np.zeros(_SLOTS, bool)
    twice[(ordered[1:][ordered[1:] == ordered[:-1]] % np.uint64(_SLOTS)).astype(np.int64)] = True
    again = whole & twice[(key % np.uint64(_SLOTS)).astype(np.int64)]
    opens, closes = again.copy(), again.copy()
    joined = again[1:] & again[:-1] & (part[1:starts] == part[: starts - 1])
    opens[1:] &= ~joined
    closes[:-1] &= ~joined
    first, behind = np.flatnonzero(opens), np.flatnonzero(closes) + window
    long = behind - first >= least
    return first[long], behind[long]


def candidate_stretches(
    codes: np.ndarray, cuts: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS
) -> list[tuple[int, int]]:
    """Word ranges outside of which no run of ``least`` words and ``periods`` periods can lie.

    ``cuts`` are the bounds of the texts in ``codes``.  A run with n words and
    period q holds n - window + 1 windows of at most q kinds, so with windows
    of about ``least / 3`` words and three periods each kind occurs twice.
    """
    if periods < 3:
        window = 1
    else:
        window = max(1, least // 3)
    base, end = _repeated_stretches(codes, cuts, window, least)
    while len(base):
        sizes = end - base
        picked = np.repeat(base - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        inner = np.concatenate([[0], np.cumsum(sizes)])
        s, e = _repeated_stretches(codes[picked], inner, window, least)
        if len(s) == len(base) and (e - s).sum() == sizes.sum():
            break
        base, end = picked[s], picked[e - 1] + 1
    return list(zip(base.tolist(), end.tolist(), strict=True))


def plant_repetition(doc_id, words: list) -> list:
    """The query's rule: with h = crc32 of the decimal id, one id in ten gets a periodic tail."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * (-(-(n - a) // p)))[: n - a]


def find_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = LEAST_WORDS,
    periods: int = LEAST_PERIODS,
    planted: bool = False,
) -> DataFrame:
    """Per row: doc_id, n_words, runs (array of start, length, period), collapsed_sha256.

    ``collapsed_sha256`` hashes the text without the words that lie in a run
    behind its first period, the rest joined by one blank.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    id_type = dict(narrow.dtypes)["doc_id"]
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = [(t or b"").split() for t in batch.column("text").to_pylist()]
            if planted:
                texts = [plant_repetition(i, words) for i, words in zip(ids, texts, strict=True)]
            cuts = np.concatenate([[0], np.cumsum([len(words) for words in texts])]).astype(np.int64)
            code: defaultdict[bytes, int] = defaultdict(count().__next__)
            codes = np.empty(cuts[-1], np.int64)
            for words, s, e in zip(texts, cuts.tolist(), cuts[1:].tolist(), strict=False):
                codes[s:e] = np.fromiter(map(code.__getitem__, words), np.int64, e - s)
            runs: list[list[Run]] = [[] for _ in ids]
            for s, e in candidate_stretches(codes, cuts, least, periods):
                row = int(np.searchsorted(cuts, s, "right")) - 1
                shift = s - int(cuts[row])
                runs[row] += [r._replace(start=r.start + shift) for r in runs_of(codes[s:e].tolist(), least, periods)]
            digests = []
            for words, found in zip(texts, runs, strict=True):
                if found:
                    found.sort(key=lambda r: (r.start, r.period))
                    drop = np.zeros(len(words) + 1, np.int64)
                    for r in found:
                        drop[r.start + r.period] += 1
                        drop[r.start + r.length] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(drop)[:-1] == 0).tolist()]
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(cuts)),
                    pa.array([[r._asdict() for r in found] for found in runs], run_type),
                    pa.array(digests, pa.string()),
                ],
                ["doc_id", "n_words", "runs", "collapsed_sha256"],
            )

    return map_batches(
        narrow,
        run,
        f"doc_id {id_type}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>,"
        " collapsed_sha256 string",
    )


def strongest(runs: list[Run]) -> Run | None:
    """The run of greatest length / period; of equals the first to start, then the shortest period."""
    return max(runs, key=lambda r: (Fraction(r.length, r.period), -r.start, -r.period), default=None)
