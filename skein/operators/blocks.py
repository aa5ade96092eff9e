"""Page versions as block rows: masking, hashing, difference, entry rendering.

A page version is the rows of one ``by`` key (for example source and version),
with ``pos`` giving document order.  Windows and lists are per version, bounded
by the size of one fetched page; nothing here groups the versions of one source
together.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import mask_patterns, sha256_hex, strip_tags
from skein.functions.urls import display_title
from skein.skew import sliced_last_value

#: A page over this many blocks is flagged; all its blocks are used.
MAX_BLOCKS = 5000
#: Most cells of alignment lengths that are held at a time, beside one row a halving.
ALIGNED_CELLS = 1 << 22
MAX_STATE_BYTES = 512 * 1024
RULES_VERSION = 1
STATE_VERSION = 1
VERSION_SLICE = 1024

STARTED, RESYNC, UNCHANGED, BELOW_MIN, HIDDEN, CHANGED = (
    "started", "resync", "unchanged", "below_min", "hidden", "changed",
)


def with_heading_context(blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Attach the nearest preceding heading's ``anchor`` and ``head`` text.

    ``blocks`` has is_heading, own_anchor and text; a heading gets the context
    of the heading before it.
    """
    before = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    heading = F.when(
        F.col("is_heading"),
        F.struct(F.coalesce("own_anchor", F.lit("")).alias("anchor"), F.col("text").alias("head")),
    )
    return (
        blocks.withColumn("_h", F.last(heading, ignorenulls=True).over(before))
        .withColumn("anchor", F.coalesce("_h.anchor", F.lit("")))
        .withColumn("head", F.coalesce("_h.head", F.lit("")))
        .drop("_h")
    )


def comparable(blocks: DataFrame, patterns: Column | None = None) -> DataFrame:
    """Set ``key`` to the masked HTML and drop blocks that mask to nothing."""
    masked = F.col("html") if patterns is None else mask_patterns(F.col("html"), patterns)
    return blocks.withColumn("key", masked).filter(strip_tags(F.col("key")) != "")


def with_mask_flag(blocks: DataFrame, patterns: Column) -> DataFrame:
    """Preview: every block with whether the patterns hide it."""
    return blocks.withColumn("masked", strip_tags(mask_patterns(F.col("html"), patterns)) == "")


def joined_in_order(value: str, separator: str = "\n") -> Column:
    """Values of a version's rows joined in document order."""
    rows = F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v"))))
    return F.array_join(F.transform(rows, lambda r: r["v"]), separator)


def content_hashes(blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    return blocks.groupBy(*by).agg(sha256_hex(joined_in_order("key")).alias("content_hash"))


def pair_with_previous(
    versions: DataFrame, source: str, version: str
) -> DataFrame:
    """(source, version, previous version) for every version but the first.

    A source may have any number of versions, so the previous one is found
    slice by slice rather than in one window per source.
    """
    sliced = versions.select(source, version).distinct().withColumn(
        "_slice", F.floor(F.col(version) / VERSION_SLICE)
    )
    return (
        sliced_last_value(
            sliced, [source], "_slice", [F.asc(version)], version, F.col(version), "previous"
        )
        .filter(F.col("previous").isNotNull())
        .drop("_slice")
    )


def previous_blocks(blocks: DataFrame, pairs: DataFrame, source: str, version: str) -> DataFrame:
    """Blocks of each previous version, relabelled with the version after it."""
    link = pairs.select(source, F.col("previous").alias(version), F.col(version).alias("_next"))
    return (
        blocks.join(link, [source, version])
        .withColumn(version, F.col("_next"))
        .drop("_next")
        .select(*blocks.columns)
    )


def block_diff(prev: DataFrame, curr: DataFrame, by: Sequence[str]) -> DataFrame:
    """Multiset difference of block keys; a block that only moved cancels out.

    Both sides carry the same ``by`` label.  Returns the surplus rows with
    ``change`` 'added' (last copies of the current side) or 'removed' (first
    copies of the previous side).  ``aligned_diff`` picks the copies by
    alignment instead; how many of each key there are is the same.
    """
    both = prev.withColumn("_side", F.lit(0)).unionByName(curr.withColumn("_side", F.lit(1)))
    same = Window.partitionBy(*by, "key")
    copy = Window.partitionBy(*by, "key", "_side").orderBy("pos")
    counted = both.withColumns(
        {
            "_was": F.sum(1 - F.col("_side")).over(same),
            "_is": F.sum("_side").over(same),
            "_copy": F.row_number().over(copy),
        }
    )
    added = (F.col("_side") == 1) & (F.col("_copy") > F.col("_was"))
    removed = (F.col("_side") == 0) & (F.col("_copy") <= F.col("_was") - F.col("_is"))
    return (
        counted.filter(added | removed)
        .withColumn("change", F.when(F.col("_side") == 1, "added").otherwise("removed"))
        .drop("_side", "_was", "_is", "_copy")
    )


def aligned_positions(prev: list, curr: list) -> tuple[list[int], list[int]]:
    """Indices (added in ``curr``, removed from ``prev``) outside a longest common subsequence, moves cancelled.

    Lengths of common subsequences of all tails are computed row by row, each
    row one running maximum.  Walking forward, equal blocks are paired; of
    two equally long ways on, the one that drops the previous side's block is
    taken.  A key that falls out on both sides has moved: as many of its first
    indices as both sides have are taken back.

    Long sides are halved: a row in the middle is computed from the last one,
    the first half is walked from it and then the second from where that walk
    ended, so a row a halving and ``ALIGNED_CELLS`` lengths are held, never
    all of the table.
    """
    codes = {key: i for i, key in enumerate(dict.fromkeys([*prev, *curr]))}
    a, b = (np.array([codes[k] for k in side], np.int32) for side in (prev, curr))
    n, m = len(a), len(b)
    added: list[int] = []
    removed: list[int] = []

    def row_before(i: int, after: np.ndarray, j: int) -> np.ndarray:
        """Lengths for tails from ``i`` and each index from ``j`` on, given those from ``i + 1``."""
        row = np.zeros_like(after)
        best = np.where(b[j:] == a[i], after[1:] + 1, after[:-1])
        row[:-1] = np.maximum.accumulate(best[::-1])[::-1]
        return row

    def walk(start: int, stop: int, j: int, last: np.ndarray) -> int:
        """Walk rows ``start`` to ``stop`` from column ``j``; ``last`` is row ``stop`` from ``j`` on."""
        if (stop - start) * len(last) > ALIGNED_CELLS and stop - start > 1:
            half = (start + stop) // 2
            middle = last
            for i in range(stop - 1, half - 1, -1):
                middle = row_before(i, middle, j)
            at = walk(start, half, j, middle)
            return walk(half, stop, at, last[at - j :])
        tails = [last]
        for i in range(stop - 1, start - 1, -1):
            tails.append(row_before(i, tails[-1], j))
        tails.reverse()
        i, at = start, j
        while i < stop and at < m:
            if a[i] == b[at]:
                i, at = i + 1, at + 1
            elif tails[i + 1 - start][at - j] >= tails[i - start][at - j + 1]:
                removed.append(i)
                i += 1
            else:
                added.append(at)
                at += 1
        removed.extend(range(i, stop))
        return at

    j = walk(0, n, 0, np.zeros(m + 1, np.int32))
    added += range(j, m)
    moved = Counter(b[added].tolist()) & Counter(a[removed].tolist())

    def kept(indices: list[int], side: np.ndarray) -> list[int]:
        left, out = Counter(moved), []
        for at in indices:
            if left[side[at]] > 0:
                left[side[at]] -= 1
            else:
                out.append(at)
        return out

    return kept(added, b), kept(removed, a)


def aligned_diff(prev: DataFrame, curr: DataFrame, by: Sequence[str], limit: int | None = None) -> DataFrame:
    """``block_diff`` with the shown copies of repeated blocks picked by alignment.

    Alignment can only change which copy is shown, and only where some but not
    all copies of a key on one side are surplus.  Pairs of versions without
    such a key keep the rows of ``block_diff``; the others are aligned one by
    one, however long they are.  A caller that wants the rows of ``block_diff``
    for long versions names a ``limit`` of blocks on a side.
    """
    plain = block_diff(prev, curr, by)
    sides = prev.select(*by, "pos", "key", F.lit(0).alias("_side")).unionByName(
        curr.select(*by, "pos", "key", F.lit(1).alias("_side"))
    )
    was, now = F.count_if(F.col("_side") == 0), F.count_if(F.col("_side") == 1)
    keys = sides.groupBy(*by, "key").agg(was.alias("_was"), now.alias("_is"))
    open_key = (F.least("_was", "_is") > 0) & (F.col("_was") != F.col("_is"))
    pairs = (
        keys.groupBy(*by)
        .agg(F.sum("_was").alias("_n"), F.sum("_is").alias("_m"), F.max(open_key).alias("_open"))
        .filter(F.col("_open") if limit is None else F.col("_open") & (F.greatest("_n", "_m") <= limit))
        .select(*by)
    )
    types = dict(sides.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in (*by, "pos")) + ", _side int"

    def align(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("pos", kind="stable")
        old, new = (ordered[ordered["_side"] == side] for side in (0, 1))
        added, removed = aligned_positions(old["key"].tolist(), new["key"].tolist())
        shown = pd.concat([new.iloc[added], old.iloc[removed]])
        return shown[[*by, "pos", "_side"]]

    shown = sides.join(pairs, list(by), "left_semi").groupBy(*by).applyInPandas(align, schema)
    both = prev.withColumn("_side", F.lit(0)).unionByName(curr.withColumn("_side", F.lit(1)))
    picked = (
        both.join(shown, [*by, "pos", "_side"], "left_semi")
        .withColumn("change", F.when(F.col("_side") == 1, "added").otherwise("removed"))
        .drop("_side")
    )
    return plain.join(pairs, list(by), "left_anti").unionByName(picked.select(*plain.columns))


def changed_chars(diff: DataFrame, by: Sequence[str]) -> DataFrame:
    """Characters of changed text per version: (by..., changed_chars)."""
    return diff.groupBy(*by).agg(F.sum(F.char_length("text")).alias("changed_chars"))


def diff_summary(diff: DataFrame, by: Sequence[str]) -> DataFrame:
    return diff.groupBy(*by).agg(
        F.count_if(F.col("change") == "added").alias("n_added"),
        F.count_if(F.col("change") == "removed").alias("n_removed"),
        F.sum(F.char_length("text")).alias("changed_chars"),
    )


def watch_decision() -> Column:
    """Outcome of one poll as a column.

    Reads has_state, state_valid, prev_rules, can_remask, prev_hash, new_hash,
    n_added, n_removed, changed_chars, min_change_chars and watch_mode.
    ``can_remask`` is false when the configuration changed but the saved
    display HTML was dropped; prev_hash is the hash after any re-masking.
    """
    c = F.col
    visible = c("n_added") + F.when(c("watch_mode") == "changes", c("n_removed")).otherwise(0)
    return (
        F.when(~c("has_state"), STARTED)
        .when(~c("state_valid") | (c("prev_rules") != RULES_VERSION) | ~c("can_remask"), RESYNC)
        .when(c("prev_hash") == c("new_hash"), UNCHANGED)
        .when((c("min_change_chars") > 0) & (c("changed_chars") < c("min_change_chars")), BELOW_MIN)
        .when(visible == 0, HIDDEN)
        .otherwise(CHANGED)
    )


def saves_state(decision: Column) -> Column:
    """Every outcome but "unchanged" stores a new baseline."""
    return decision != UNCHANGED


def emits_entry(decision: Column) -> Column:
    return decision.isin(STARTED, CHANGED)


def render_changes(diff: DataFrame, by: Sequence[str], with_removed: bool = True) -> DataFrame:
    """Entry body per version: counts, added blocks, removed blocks.

    Removed blocks without saved HTML are counted but not shown; without
    ``with_removed`` (additions mode) they are not even counted.
    """
    shown = diff if with_removed else diff.filter(F.col("change") == "added")
    rows = F.array_sort(
        F.collect_list(F.struct("pos", F.concat("html", F.lit("\n")).alias("v"), "change", "html"))
    )

    def part(name: str) -> Column:
        mine = F.filter(F.col("_rows"), lambda r: (r["change"] == name) & (F.coalesce(r["html"], F.lit("")) != ""))
        return F.array_join(F.transform(mine, lambda r: r["v"]), "")

    def wrapped(tag: str, n: Column, inner: Column) -> Column:
        return F.when(n > 0, F.concat(F.lit(f"<{tag}>\n"), inner, F.lit(f"</{tag}>\n"))).otherwise("")

    grouped = shown.groupBy(*by).agg(
        rows.alias("_rows"),
        F.count_if(F.col("change") == "added").alias("n_added"),
        F.count_if(F.col("change") == "removed").alias("n_removed"),
    )
    head = F.concat(
        F.lit("<p>"), F.col("n_added").cast("string"), F.lit(" ブロック追加 / "),
        F.col("n_removed").cast("string"), F.lit(" ブロック削除</p>\n"),
    )
    body = F.concat(
        head,
        wrapped("ins", F.col("n_added"), part("added")),
        wrapped("del", F.col("n_removed"), part("removed")),
    )
    return grouped.withColumn("body", body).drop("_rows")


STARTED_BODY = "<p>監視を開始しました。</p>\n"


def full_page_section(blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """The optional trailing copy of the whole watched page: (by..., full_body)."""
    lines = blocks.withColumn("_line", F.concat("html", F.lit("\n")))
    return lines.groupBy(*by).agg(
        F.concat(
            F.lit("<hr>\n<p>ページ全文（監視対象部分）</p>\n<div>\n"),
            joined_in_order("_line", ""),
            F.lit("</div>\n"),
        ).alias("full_body")
    )


def entry_title(page_title: Column, url: Column, decision: Column, now: int) -> Column:
    stamp = F.date_format(F.timestamp_seconds(F.lit(now)), "MM/dd HH:mm")
    suffix = F.when(decision == STARTED, "監視開始").otherwise("更新")
    return F.concat(display_title(page_title, url), F.lit(" — "), suffix, F.lit(" ("), stamp, F.lit(")"))


def entry_guid(guid_mode: Column, url: Column, content_hash: Column, now: int) -> Column:
    """Content mode repeats its id when a page returns to an earlier state."""
    stamp = F.date_format(F.timestamp_seconds(F.lit(now)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revision = F.concat(url, F.lit("|"), stamp)
    return sha256_hex(F.when(guid_mode == "revision", revision).otherwise(content_hash))


def bounded_state(blocks: DataFrame, by: Sequence[str], max_bytes: int = MAX_STATE_BYTES) -> DataFrame:
    """Saved baseline rows; display HTML is dropped where a version is over ``max_bytes``.

    The size is that of the version's JSON rows, as they would be stored.
    """
    per_version = Window.partitionBy(*by)
    row = F.to_json(F.struct(F.col("key").alias("k"), F.col("html").alias("h"),
                             F.nullif("anchor", F.lit("")).alias("a"), F.nullif("head", F.lit("")).alias("t")))
    size = F.sum(F.octet_length(row) + 1).over(per_version)
    return (
        blocks.withColumn("_size", size)
        .withColumn("html", F.when(F.col("_size") <= max_bytes, F.col("html")))
        .drop("_size")
    )


def remask_state(state: DataFrame, by: Sequence[str], patterns: Column) -> DataFrame:
    """Re-key saved blocks under new patterns.

    ``can_remask`` is false for versions whose display HTML was dropped: those
    keep their old keys and must be resynced.
    """
    lost = F.max(F.col("html").isNull()).over(Window.partitionBy(*by))
    return (
        state.withColumn("can_remask", ~lost)
        .withColumn(
            "key",
            F.when(F.col("can_remask"), mask_patterns(F.col("html"), patterns)).otherwise(F.col("key")),
        )
        .filter(~F.col("can_remask") | (strip_tags(F.col("key")) != ""))
    )
