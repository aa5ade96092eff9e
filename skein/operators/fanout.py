"""Fan-out of entries to subscribers, with per-user ignore-word flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import ascii_lower, folds_plainly, like_contains_word, like_word
from skein.session import cut_lineage
from skein.skew import salted_join

# Target size of one group of words tested against an entry in one pass.
WORDS_PER_GROUP = 256
# Target number of subscribers whose marks on an entry travel with one copy of it.
USERS_PER_CELL = 1024

STATE_COLUMNS = ["user_id", "entry_id", "feed_id", "published_at", "created_at", "read_at", "ignored"]


def word_hits(entries: DataFrame, feed_words: DataFrame) -> DataFrame:
    """(entry_id, feed_id, word) where a word wanted on the feed is in the title or body.

    ``feed_words`` (feed_id, word) are distinct and lower-cased.  They are
    hashed into groups of about ``WORDS_PER_GROUP``, so an entry is copied once
    per group.
    """
    sizes = feed_words.groupBy("feed_id").agg(F.count(F.lit(1)).alias("_n"))
    # A probe is a literal every match must contain: one substring search on
    # the lower-cased text decides almost all words, and only the rest are
    # matched exactly.
    probed = like_word(F.col("word"))
    groups = (
        feed_words.join(sizes, "feed_id")
        .withColumn("_g", F.pmod(F.xxhash64("word"), F.ceil(F.col("_n") / WORDS_PER_GROUP)))
        .groupBy("feed_id", "_g")
        .agg(F.collect_list(probed).alias("_words"))
        .drop("_g")
    )
    texts = entries.select(
        F.col("id").alias("entry_id"),
        "feed_id",
        "title",
        "body",
    )

    def found(w: Column) -> Column:
        def in_text(column: str) -> Column:
            return like_contains_word(F.col(column), F.col(f"_{column}"), F.col("_plain"), w)

        return in_text("title") | in_text("body")

    # Lower-cased after the join: a text is exchanged once, not in two forms.
    met = texts.join(groups, "feed_id").withColumns(
        {
            "_title": F.lower("title"),
            "_body": F.lower("body"),
            "_plain": folds_plainly(F.concat("title", "body")),
        }
    )
    return met.select(
        "entry_id",
        "feed_id",
        F.explode(F.transform(F.filter("_words", found), lambda w: w["word"])).alias("word"),
    )


def ignored_pairs(entries: DataFrame, subscriptions: DataFrame, ignore_words: DataFrame) -> DataFrame:
    """(user_id, entry_id) pairs where an ignore word hits the title or body.

    The text is matched once per feed word, not once per subscriber: words are
    first reduced to the distinct ones wanted on each feed.  Everything is an
    equi-join.
    """
    wanted = (
        subscriptions.select("user_id", "feed_id")
        .join(ignore_words.select("user_id", ascii_lower(F.col("word")).alias("word")).distinct(), "user_id")
    )
    hits = word_hits(entries, wanted.select("feed_id", "word").distinct())
    pairs = salted_join(
        hits, wanted, ["feed_id", "word"], F.col("entry_id"), F.col("user_id"), count_left=False
    )
    return pairs.select("user_id", "entry_id").distinct()


def subscriber_rows(
    entries: DataFrame, subscriptions: DataFrame, marks: Mapping[str, DataFrame]
) -> DataFrame:
    """``entries`` (entry_id, feed_id, ...) once per subscriber, with what marks say of the pair.

    Each of ``marks`` (user_id, entry_id, value), unique by pair, becomes a
    column, null where a pair has no mark; columns of ``subscriptions`` beside
    the key come along.  A feed's subscribers are dealt by
    hash into cells of about ``USERS_PER_CELL``, an entry is copied once per
    cell and takes the marks of that cell with it as lists.  So rows of
    (subscriber, entry) leave the join complete: what is exchanged is entries
    a cell, subscriptions and marks, never the product.
    """
    sizes = subscriptions.groupBy("feed_id").agg(
        F.ceil(F.count(F.lit(1)) / USERS_PER_CELL).cast("int").alias("_cells")
    )
    cell = F.pmod(F.xxhash64("user_id"), F.col("_cells")).cast("int")
    own = [c for c in subscriptions.columns if c not in ("user_id", "feed_id")]
    people = subscriptions.join(sizes, "feed_id").select("feed_id", "user_id", *own, cell.alias("_cell"))
    placed = entries.join(sizes, "feed_id")
    spots = placed.withColumn("_cell", F.explode(F.sequence(F.lit(0), F.col("_cells") - 1))).drop("_cells")
    marked = spots
    for name, pairs in marks.items():
        lists = (
            pairs.join(placed.select("entry_id", "_cells").distinct(), "entry_id")
            .groupBy("entry_id", cell.alias("_cell"))
            .agg(F.collect_list(F.struct("user_id", "value")).alias("_l"))
            .select("entry_id", "_cell", F.col("_l.user_id").alias(f"_u_{name}"), F.col("_l.value").alias(f"_v_{name}"))
        )
        marked = marked.join(lists, ["entry_id", "_cell"], "left")
    rows = salted_join(
        marked, people, ["feed_id", "_cell"], F.col("entry_id"), F.col("user_id"), counted_as=spots
    )

    def value(name: str) -> Column:
        place = F.array_position(f"_u_{name}", F.col("user_id"))
        return F.get(f"_v_{name}", (place - 1).cast("int")).alias(name)

    return rows.select("user_id", *entries.columns, *own, *[value(name) for name in marks])


def fan_out(
    entries: DataFrame,
    subscriptions: DataFrame,
    ignore_words: DataFrame,
    read_at: str | None = None,
    reads: DataFrame | None = None,
    marks: Mapping[str, DataFrame] | None = None,
    entry_columns: Sequence[str] = (),
    user_columns: Sequence[str] = (),
    hidden: DataFrame | None = None,
) -> DataFrame:
    """One state row per (subscriber, entry).

    ``read_at`` names a column of ``entries`` giving the initial read time
    (batches without dates), ``reads`` (user_id, entry_id, read_at) holds
    subscribers' own marks, which win; by default every row starts unread.
    ``marks`` are more columns as in :func:`subscriber_rows`, ``entry_columns``
    and ``user_columns`` name those that rows take from their entry and their
    subscription, so that no join brings them to the product afterwards.
    ``hidden`` are the pairs of :func:`ignored_pairs` where they are known.
    """
    slim = entries.select(
        F.col("id").alias("entry_id"),
        "feed_id",
        "published_at",
        "created_at",
        (F.col(read_at) if read_at else F.lit(None)).cast("bigint").alias("read_at"),
        *entry_columns,
    )
    if hidden is None:
        hidden = ignored_pairs(entries, subscriptions, ignore_words)
    carried = {"_hit": hidden.withColumn("value", F.lit(1)), **(marks or {})}
    if reads is not None:
        carried["_read"] = reads.select("user_id", "entry_id", F.col("read_at").cast("bigint").alias("value"))
    rows = subscriber_rows(slim, subscriptions.select("user_id", "feed_id", *user_columns), carried)
    if reads is not None:
        rows = rows.withColumn("read_at", F.coalesce("_read", "read_at"))
    more = [*(marks or {}), *entry_columns, *user_columns]
    return rows.withColumn("ignored", F.coalesce("_hit", F.lit(0))).select(*STATE_COLUMNS, *more)


def backfill_new_subscribers(
    entries: DataFrame,
    new_subscriptions: DataFrame,
    ignore_words: DataFrame,
    state: DataFrame | None,
    held: DataFrame | None = None,
) -> DataFrame:
    """State rows that joining subscribers still lack; existing rows win.

    How much of a feed a pair holds is read from its number of rows and a
    64-bit digest of their entries (combined on the map side).  A pair without
    rows gets all of the feed and one with the feed's own number and digest
    nothing; only rows of pairs that hold a part are compared with the state.
    ``held`` (user_id, feed_id) are the pairs that hold their whole feed, where
    that is known: the rest holds nothing then and no state row is read.
    """
    if held is not None:
        lacking = new_subscriptions.select("user_id", "feed_id").join(held, ["user_id", "feed_id"], "left_anti")
        wanted = entries.join(lacking.select("feed_id").distinct(), "feed_id", "left_semi")
        return fan_out(wanted, cut_lineage(lacking), ignore_words)
    pair, keys = ["user_id", "feed_id"], ["user_id", "entry_id"]

    def digest(entry: str) -> Column:
        return F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64(entry)))

    held = state.groupBy(*pair).agg(digest("entry_id").alias("_held"))
    whole = entries.groupBy("feed_id").agg(digest("id").alias("_whole"))
    asked = new_subscriptions.select(*pair).join(held, pair, "left").join(whole, "feed_id")
    lacking = asked.filter("_held IS NULL OR _held <> _whole").withColumn("_part", F.col("_held").isNotNull())
    asked = cut_lineage(lacking.drop("_held", "_whole"))
    wanted = entries.join(new_subscriptions.select("feed_id").distinct(), "feed_id", "left_semi")
    rows = fan_out(wanted, asked, ignore_words, user_columns=["_part"])
    if asked.filter("_part").isEmpty():
        return rows.drop("_part")
    own = state.join(asked.filter("_part").select(*pair).distinct(), pair, "left_semi").select(*keys)
    torn = rows.filter("_part").join(own, keys, "left_anti").select(*rows.columns)
    return rows.filter("NOT _part").unionByName(torn).drop("_part")


def backfill_from_single_user(
    entries: DataFrame, subscriptions: DataFrame, legacy_flags: DataFrame
) -> DataFrame:
    """State rows from pre-multi-user flags, for subscribed feeds only.

    ``legacy_flags`` holds (entry_id, read_at, ignored) of the one old user;
    entries keep no registration time, so the fetch time stands in for it.
    """
    flagged = (
        entries.select(
            F.col("id").alias("entry_id"), "feed_id", "published_at", F.col("fetched_at").alias("created_at")
        )
        .join(legacy_flags, "entry_id")
    )
    rows = salted_join(
        flagged, subscriptions.select("user_id", "feed_id"), ["feed_id"], F.col("entry_id"), F.col("user_id")
    )
    return rows.select(*STATE_COLUMNS)
