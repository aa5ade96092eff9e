"""Removal of byte strings that an earlier document also holds, by hash-compared suffix sorting.

A byte is removed when a ``SIZE``-byte string that covers it also starts in a
document with a smaller doc_id.  Windows of ``SIZE`` bytes are dealt by an
anchor: the smallest-hashed ``GRAM``-byte gram inside the window (leftmost of
equals).  Equal windows have equal anchors, and consecutive windows share one,
so a document is cut into stretches of windows, one an anchor, about one for 16
bytes.

1. Anchors go to buckets by hash; those found in one document only drop out.
2. Documents with shared anchors cut out the bytes of those stretches.
   Stretches with equal bytes inside a batch leave only the smallest doc_id:
   the others are already decided, so a passage in a third of all documents
   travels once a batch.
3. In a bucket, stretches of one anchor that differ are compared window by
   window: the windows at equal distance from the anchor are merge-sorted as
   suffixes, where another one has the same hash.  A comparison takes prefix
   polynomial hashes and finds the common extension by binary search.  Neighbours that agree in ``SIZE`` bytes are
   checked byte by byte.
4. The removed ranges are merged a document, meet their document again and are cut.

Null and empty texts have no bytes.  Rows with one doc_id never remove from
each other; a null doc_id counts as larger than any other.  Repeated rows give
repeated results.  Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import map_batches
from skein.llm.textbytes import mix, prefix_hashes, span_hashes, text_bytes

SIZE = 50
GRAM = 20
SLICE_BYTES = 2 << 20
BUCKET_BYTES = 24 << 20
LAST = (1 << 63) - 1


def anchors(data: np.ndarray, offsets: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, first window, number of windows, anchor position, anchor hash) of every stretch."""
    none = np.zeros(0, np.int64)
    if len(data) < size:
        return none, none, none, none, none.astype(np.uint64)
    prefix = prefix_hashes(data)
    at = np.arange(len(data) - gram + 1)
    grams = mix(span_hashes(prefix, at, at + gram))
    # Leftmost minimum of each run of size - gram + 1 grams, by doubling.
    span, width = size - gram + 1, 1
    least, place = grams, at.astype(np.int32)
    while width < span:
        step = min(width, span - width)
        right = least[step:] < least[:-step]
        place = np.where(right, place[step:], place[:-step])
        least = np.where(right, least[step:], least[:-step])
        width += step
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(place)]
    inside = np.arange(len(place)) + size <= offsets[row + 1]
    windows = np.flatnonzero(inside)
    if not len(windows):
        return none, none, none, none, none.astype(np.uint64)
    place, row = place[windows].astype(np.int64), row[windows]
    heads = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])]))
    count = np.diff(np.concatenate([heads, [len(windows)]]))
    return row[heads], windows[heads], count, place[heads], grams[place[heads]]


def _anchor_hashes(data: np.ndarray, at: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of the grams at ``at``, in pieces so that no prefix array spans all the data."""
    out = np.zeros(len(at), np.uint64)
    for piece in range(0, len(data), SLICE_BYTES):
        own = np.flatnonzero((at >= piece) & (at < piece + SLICE_BYTES))
        local = at[own] - piece
        out[own] = mix(span_hashes(prefix_hashes(data[piece : piece + SLICE_BYTES + gram]), local, local + gram))
    return out


def common_extension(prefix: np.ndarray, x: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    """Length, at most ``limit``, of the common prefix of the suffixes at x and y, by binary search on hashes."""
    found = np.zeros(len(x), np.int64)
    step = 1 << (limit.bit_length() - 1)
    while step:
        longer = found + step
        fits = longer <= limit
        a, b = np.where(fits, x, 0), np.where(fits, y, 0)
        size = np.where(fits, longer, 0)
        same = span_hashes(prefix, a, a + size) == span_hashes(prefix, b, b + size)
        found = np.where(fits & same, longer, found)
        step >>= 1
    return found


def suffix_merge_sort(
    data: np.ndarray, prefix: np.ndarray, suffix: np.ndarray, group: np.ndarray, limit: int
) -> np.ndarray:
    """Order of ``suffix`` by the ``limit`` bytes there, inside runs of equal ``group``; stable.

    Bottom-up merges of all groups at once: an item's place after a merge is
    its place in its block plus its rank in the partner block, found by binary
    search with suffix comparisons.
    """
    n = len(suffix)
    order = np.arange(n)
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([heads, [n]]))
    first, count = np.repeat(heads, sizes), np.repeat(sizes, sizes)
    local = np.arange(n) - first

    def before(x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        out = ties.copy()
        part = np.flatnonzero(span_hashes(prefix, x, x + limit) != span_hashes(prefix, y, y + limit))
        x, y = x[part], y[part]
        same = common_extension(prefix, x, y, limit)
        out[part] = data[x + same] < data[y + same]
        return out

    width = 1
    while n and width < sizes.max():
        todo = np.flatnonzero(count > width)
        block = local[todo] // width
        partner = (block ^ 1) * width
        size = np.clip(count[todo] - partner, 0, width)
        low, high = np.zeros(len(todo), np.int64), size.copy()
        mine = suffix[order[todo]]
        left = block % 2 == 0
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            other = suffix[order[first[todo[open_]] + partner[open_] + middle]]
            # A left item passes partners that are smaller, a right one also equal ones.
            passes = before(other, mine[open_], ~left[open_])
            low[open_] = np.where(passes, middle + 1, low[open_])
            high[open_] = np.where(passes, high[open_], middle)
            open_ = open_[low[open_] < high[open_]]
        target = first[todo] + (block // 2) * 2 * width + local[todo] % width + low
        moved = order.copy()
        moved[target] = order[todo]
        order = moved
        width *= 2
    return order


def _gather(data: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    return data[starts[:, None] + np.arange(size)]


def window_minimum(data: np.ndarray, starts: np.ndarray, group: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """For each window: the least ``value`` among windows of its group with the same bytes."""
    if not len(starts):
        return np.zeros(0, np.int64)
    prefix = prefix_hashes(data)
    # Equal windows have equal hashes: only those of one hash in a group are sorted against each other,
    # and one that is alone with its hash is its own least.
    whole = span_hashes(prefix, starts, starts + size)
    by = np.lexsort((whole, group))
    fresh = np.ones(len(by) + 1, bool)
    fresh[1:-1] = (group[by[1:]] != group[by[:-1]]) | (whole[by[1:]] != whole[by[:-1]])
    met = ~(fresh[:-1] & fresh[1:])
    pick = by[met]
    out = value.astype(np.int64)
    if len(pick):
        out[pick] = _sorted_minimum(data, prefix, starts[pick], np.cumsum(fresh[:-1])[met], value[pick], size)
    return out


def _sorted_minimum(
    data: np.ndarray, prefix: np.ndarray, starts: np.ndarray, group: np.ndarray, value: np.ndarray, size: int
) -> np.ndarray:
    """``window_minimum`` by the order of the windows as suffixes."""
    order = suffix_merge_sort(data, prefix, starts, group, size)
    s, g = starts[order], group[order]
    near = g[1:] == g[:-1]
    same = near & (span_hashes(prefix, s[1:], s[1:] + size) == span_hashes(prefix, s[:-1], s[:-1] + size))
    for at in range(0, len(same), 200_000):  # collision check, in pieces of bounded memory
        pick = np.flatnonzero(same[at : at + 200_000]) + at
        if (_gather(data, s[pick], size) != _gather(data, s[pick + 1], size)).any():
            exact = np.array([data[i : i + size].tobytes() for i in starts], dtype=f"S{size}")
            order = np.lexsort((exact, group))
            s, g = starts[order], group[order]
            same = (g[1:] == g[:-1]) & (exact[order][1:] == exact[order][:-1])
            break
    run = np.concatenate([[0], np.cumsum(~same)])
    least = np.full(run[-1] + 1, LAST, np.int64)
    np.minimum.at(least, run, value[order])
    out = np.empty(len(starts), np.int64)
    out[order] = least[run]
    return out


def _runs(flags: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of every run of set flags with one owner."""
    edge = np.flatnonzero(flags)
    if not len(edge):
        return edge, edge
    cut = np.flatnonzero((np.diff(edge) > 1) | (owner[edge[1:]] != owner[edge[:-1]])) + 1
    return edge[np.concatenate([[0], cut])], edge[np.concatenate([cut - 1, [len(edge) - 1]])]


_STAGE_A = "bucket int, high binary, low binary, at binary, first binary, offset binary, count binary, docs binary, rows binary"
_SHARED = "part int, row binary, doc binary, first binary, offset binary, count binary"
_MARKS = "row bigint, doc bigint, first binary, offset binary, count binary"
_STRETCH = "bucket int, doc binary, row binary, first binary, offset binary, count binary, bytes binary, done binary"
_GONE = "part int, row binary, doc binary, start binary, end binary"
_RANGES = "row bigint, doc bigint, start binary, end binary"


def _table(schema: str, rows: list[dict]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [f.strip().split() for f in schema.split(",")]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[n] for r in rows], kinds[k]) for n, k in fields], [n for n, _ in fields]
    )


def _slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes."""
    start = 0
    while start < len(offsets) - 1:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, min(end, len(offsets) - 1)
        start = min(end, len(offsets) - 1)


def _find_anchors(size: int, gram: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            ids, keys = batch.column("doc").to_numpy(), batch.column("row").to_numpy()
            for a, b in _slices(offsets, SLICE_BYTES):
                base = offsets[a]
                row, first, count, place, h = anchors(data[base : offsets[b]], offsets[a : b + 1] - base, size, gram)
                if not len(row):
                    continue
                local = first - (offsets[a + row] - base)
                # 40 bits tell anchors of a bucket apart well enough: an accident is sorted out in step 3.
                columns = {
                    "high": (h >> np.uint64(32)).astype("<u4"),
                    "low": (h >> np.uint64(24)).astype(np.uint8),
                    "first": local.astype("<u4"),
                    "offset": (place - first).astype(np.uint8),
                    "count": count.astype(np.uint8),
                }
                packed = []
                for pick in _split_rows((h % np.uint64(buckets)).astype(np.int64)):
                    own, at = np.unique(row[pick], return_inverse=True)  # each document once a bucket
                    packed.append(
                        {n: _pack(v[pick]) for n, v in columns.items()}
                        | {
                            "bucket": int(h[pick[0]] % np.uint64(buckets)),
                            "at": _pack(at.astype("<u4")),
                            "docs": _pack(ids[a + own]),
                            "rows": _pack(keys[a + own]),
                        }
                    )
                yield _table(_STAGE_A, packed)

    return run


_ANCHOR = ("row", "doc", "first", "offset", "count")
_ENTRY = ("doc", "row", "first", "offset", "count", "done")
_TYPES = {"high": "<u4", "low": "u1", "first": "<u4", "at": "<u4", "offset": "u1", "count": "u1", "done": "u1"}
_TYPES |= {"start": "<u4", "end": "<u4"}
_TYPES |= dict.fromkeys(("doc", "row", "docs", "rows"), "<i8") | {"bytes": "u1"}


def _unpacked(table: pa.Table, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    none = {n: np.zeros(0, _TYPES[n]) for n in names}
    return {n: np.concatenate([none[n], *(_unpack(x, _TYPES[n]) for x in table.column(n).to_pylist())]) for n in names}


def _pack(values: np.ndarray) -> bytes:
    """An array as zstd of its byte planes, behind its size."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return values.nbytes.to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(raw: bytes, dtype: str) -> np.ndarray:
    size, width = int.from_bytes(raw[:8], "little"), np.dtype(dtype).itemsize
    if not size:
        return np.zeros(0, dtype)
    planes = pa.decompress(raw[8:], size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def _split_rows(*keys: np.ndarray) -> Iterator[np.ndarray]:
    """Positions of equal keys, a group at a time."""
    if not len(keys[0]):
        return
    order = np.lexsort(keys)
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for key in keys:
        fresh[1:] |= np.diff(key[order]) != 0
    heads = np.flatnonzero(fresh).tolist()
    for s, t in zip(heads, [*heads[1:], len(order)], strict=True):
        yield order[s:t]


def _keep_shared(parts: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        """Of one bucket: the anchors that stand in two documents or more, packed by part of the rows."""
        e = _unpacked(table, ("high", "low", "at", "first", "offset", "count", "docs", "rows"))
        sizes = {n: [int.from_bytes(x[:8], "little") for x in table.column(n).to_pylist()] for n in ("count", "docs")}
        entries, known = sizes["count"], np.array(sizes["docs"], np.int64) // 8
        at = e.pop("at") + np.repeat(np.cumsum(known) - known, entries)
        e |= {"doc": e.pop("docs")[at], "row": e.pop("rows")[at]}
        e["hash"] = (e.pop("high").astype(np.uint64) << np.uint64(8)) | e.pop("low").astype(np.uint64)
        order = np.argsort(e["hash"], kind="stable")
        h, doc = e["hash"][order], e["doc"][order]
        heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else order
        sizes = np.diff(np.concatenate([heads, [len(h)]]))
        shared = np.repeat(np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads), sizes) if len(h) else h > 0
        pick = order[shared]
        pick = pick[np.lexsort((e["first"][pick], e["doc"][pick], e["row"][pick]))]
        e = {n: e[n][pick] for n in _ANCHOR}
        part = (mix(e["row"].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        rows = [
            {"part": int(part[own[0]])} | {n: _pack(e[n][own]) for n in _ANCHOR} for own in _split_rows(part)
        ]
        return pa.Table.from_batches([_table(_SHARED, rows)])

    return run


def _marks_of_part(table: pa.Table) -> pa.Table:
    """Of one part: the shared anchors of each of its rows, once where the row is repeated."""
    e = _unpacked(table, _ANCHOR)
    rows = []
    for own in _split_rows(e["row"], e["doc"]):
        _, once = np.unique(e["first"][own], return_index=True)
        pick = own[once]
        rows.append(
            {n: int(e[n][own[0]]) for n in ("row", "doc")}
            | {n: e[n][pick].tobytes() for n in ("first", "offset", "count")}
        )
    return pa.Table.from_batches([_table(_MARKS, rows)])


def _content_order(e: dict[str, np.ndarray], data: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """Entries by (anchor, bytes, doc) and, for each, whether it repeats the bytes of the one before."""
    whole = mix(span_hashes(prefix_hashes(data), starts, starts + lengths)) + lengths.astype(np.uint64)
    order = np.lexsort((e["doc"], e["offset"], whole, e["hash"]))
    a, b = order[:-1], order[1:]
    same = (e["hash"][a] == e["hash"][b]) & (whole[a] == whole[b]) & (e["offset"][a] == e["offset"][b])
    for size in np.unique(lengths[b[same]]):  # collision check: unequal bytes are kept apart
        pick = np.flatnonzero(same & (lengths[b] == size) & (lengths[a] == size))
        for at in range(0, len(pick), 100_000):
            part = pick[at : at + 100_000]
            same[part] = (_gather(data, starts[a[part]], size) == _gather(data, starts[b[part]], size)).all(axis=1)
    return order, np.concatenate([[False], same]) if len(order) else same


def _cut_stretches(size: int, gram: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("first").is_valid())
            if not batch.num_rows:
                continue
            data, offsets = text_bytes(batch.column("text"))
            ids, keys = batch.column("doc").to_numpy(), batch.column("row").to_numpy()
            lists = {n: batch.column(n).to_pylist() for n in ("first", "offset", "count")}
            n_each = np.array([len(x) for x in lists["count"]])
            at = np.repeat(np.arange(batch.num_rows), n_each)
            e = {n: np.frombuffer(b"".join(v), _TYPES[n]) for n, v in lists.items()}
            e |= {"doc": ids[at], "row": keys[at]}
            starts = offsets[at] + e["first"]
            lengths = e["count"].astype(np.int64) + size - 1
            e["hash"] = _anchor_hashes(data, starts + e["offset"], gram)
            order, repeats = _content_order(e, data, starts, lengths)
            # A repeat of an earlier doc_id's bytes is decided here; only the first goes on.
            head = np.maximum.accumulate(np.where(repeats, 0, np.arange(len(order))))
            done = np.zeros(len(order), bool)
            done[order] = repeats & (e["doc"][order] > e["doc"][order[head]])
            e["done"] = done.astype(np.uint8)
            bucket = (e["hash"] % np.uint64(buckets)).astype(np.int64)
            bucket[done] = (mix(e["row"][done].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            rows = []
            for pick in _split_rows(bucket):
                live = pick[~done[pick]]
                spread = np.repeat(starts[live] - (np.cumsum(lengths[live]) - lengths[live]), lengths[live])
                rows.append(
                    {"bucket": int(bucket[pick[0]]), "bytes": _pack(data[spread + np.arange(len(spread))])}
                    | {n: _pack(e[n][pick]) for n in _ENTRY}
                )
            yield _table(_STRETCH, rows)

    return run


def _decide(size: int, gram: int, parts: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        """Of one bucket: the removed byte ranges, packed by part of the rows."""
        e = _unpacked(table, (*_ENTRY, "bytes"))
        data = e.pop("bytes")
        done = e["done"] > 0
        first = e["first"].astype(np.int64)
        last = first + e["count"] - 1 + size
        gone = [(e["row"][done], e["doc"][done], first[done], last[done])]
        e = {k: v[~done] for k, v in e.items()}
        lengths = e["count"].astype(np.int64) + size - 1
        starts = np.cumsum(lengths) - lengths
        e["hash"] = _anchor_hashes(data, starts + e["offset"], gram)
        # An anchor's stretches stay together; parts of the anchors bound the memory of the hashes.
        pieces = -(-len(data) // SLICE_BYTES)
        for own in _split_rows((mix(e["hash"]) % np.uint64(max(1, pieces))).astype(np.int64)):
            spread = np.repeat(starts[own] - (np.cumsum(lengths[own]) - lengths[own]), lengths[own])
            gone.append(_removed({k: v[own] for k, v in e.items()}, data[spread + np.arange(len(spread))], size))
        row, doc, start, end = (np.concatenate([g[i] for g in gone]) for i in range(4))
        order = np.lexsort((start, doc, row))
        row, doc, start, end = row[order], doc[order], start[order], end[order]
        part = (mix(row.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        rows = [
            {"part": int(part[own[0]]), "row": _pack(row[own]), "doc": _pack(doc[own])}
            | {"start": _pack(start[own].astype("<u4")), "end": _pack(end[own].astype("<u4"))}
            for own in _split_rows(part)
        ]
        return pa.Table.from_batches([_table(_GONE, rows)])

    return run


def _ranges_of_part(table: pa.Table) -> pa.Table:
    """Of one part: the merged removed ranges of each of its rows."""
    e = _unpacked(table, ("row", "doc", "start", "end"))
    rows = []
    for own in _split_rows(e["row"], e["doc"]):
        start, end = merged_ranges(e["start"][own], e["end"][own])
        rows.append(
            {"row": int(e["row"][own[0]]), "doc": int(e["doc"][own[0]]), "start": start.tobytes(), "end": end.tobytes()}
        )
    return pa.Table.from_batches([_table(_RANGES, rows)])


def _removed(e: dict[str, np.ndarray], data: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """(row, doc, start, end) of the ranges that smaller doc_ids take from these stretches."""
    lengths = e["count"].astype(np.int64) + size - 1
    starts = np.cumsum(lengths) - lengths
    first = e["first"].astype(np.int64)
    order, repeats = _content_order(e, data, starts, lengths)
    content = np.cumsum(~repeats) - 1
    lead = order[~repeats]
    # Contents whose anchor has several: window by window.
    h = e["hash"][lead]
    several = np.zeros(len(lead), bool)
    several[1:] |= h[1:] == h[:-1]
    several[:-1] |= h[1:] == h[:-1]
    pick = np.flatnonzero(several)
    windows = e["count"][lead[pick]].astype(np.int64)
    owner = np.repeat(pick, windows)
    number = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    relative = number - e["offset"][lead[owner]]
    by = np.lexsort((relative, h[owner]))
    key_h, key_r = h[owner][by], relative[by]
    fresh = np.ones(len(by), bool)
    fresh[1:] = (key_h[1:] != key_h[:-1]) | (key_r[1:] != key_r[:-1])
    least = np.zeros(len(owner), np.int64)
    least[by] = window_minimum(
        data, (starts[lead[owner]] + number)[by], np.cumsum(fresh), e["doc"][lead[owner]][by], size
    )
    begin = np.full(len(lead), -1, np.int64)  # where the windows of a content begin in ``least``
    begin[pick] = np.cumsum(windows) - windows
    mine = e["doc"][order]
    later = mine > e["doc"][lead[content]]
    whole = order[later]
    rest = np.flatnonzero(~later & (begin[content] >= 0))
    count = e["count"][order[rest]].astype(np.int64)
    entry = np.repeat(np.arange(len(rest)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    flags = least[begin[content[rest[entry]]] + place] < mine[rest[entry]]
    s, t = _runs(flags, entry)
    part = order[rest[entry[s]]]
    who = np.concatenate([whole, part])
    start = np.concatenate([first[whole], first[part] + place[s]])
    end = np.concatenate([first[whole] + lengths[whole], first[part] + place[t] + size])
    return e["row"][who], e["doc"][who], start, end


def merged_ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(start, kind="stable")
    start, top = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    fresh = np.flatnonzero(np.concatenate([[True], start[1:] > top[:-1]])) if len(start) else order
    return start[fresh], top[np.concatenate([fresh[1:] - 1, [len(top) - 1]])] if len(start) else top


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, gram: int = GRAM
) -> DataFrame:
    """doc_id, n_bytes, ``removed`` (merged byte ranges) and ``kept`` (the remaining bytes) of every row."""
    base = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"),
    )
    base = base.withColumn("row", F.xxhash64("doc_id", "text")).withColumn("doc", F.coalesce("doc_id", F.lit(LAST)))
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_BYTES))

    found = map_batches(base, _find_anchors(size, gram, buckets), _STAGE_A, SLICE_BYTES)
    # A part of the rows gets one packed row from each bucket, and gives one row a document.
    shared = found.groupBy("bucket").applyInArrow(_keep_shared(buckets), _SHARED)
    by_row = shared.groupBy("part").applyInArrow(_marks_of_part, _MARKS)
    with_text = base.join(by_row, ["row", "doc"], "left")
    stretches = map_batches(with_text, _cut_stretches(size, gram, buckets), _STRETCH, SLICE_BYTES)
    gone = stretches.groupBy("bucket").applyInArrow(_decide(size, gram, buckets), _GONE)
    ranges = gone.groupBy("part").applyInArrow(_ranges_of_part, _RANGES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            removed, kept, sizes = [], [], []
            for raw, start, end in zip(
                batch.column("text").to_pylist(),
                batch.column("start").to_pylist(),
                batch.column("end").to_pylist(),
                strict=True,
            ):
                s, e = np.frombuffer(start or b"", "<u4"), np.frombuffer(end or b"", "<u4")
                pairs = list(zip(s.tolist(), e.tolist(), strict=True))
                edges = [0, *(x for p in pairs for x in p), len(raw)]
                kept.append(b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
                removed.append([{"start": a, "end": b} for a, b in pairs])
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(removed, span),
                    pa.array(kept, pa.binary()),
                ],
                ["doc_id", "n_bytes", "removed", "kept"],
            )

    schema = "doc_id bigint, n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept binary"
    return map_batches(base.join(ranges, ["row", "doc"], "left"), cut, schema, SLICE_BYTES)

