"""Balanced label propagation: linked documents move to one shard, sizes stay even.

Documents are linked when their texts are equal.  Every linked document starts
in a shard by hash.  Each round joins a group's counts per shard with the shard
most of its members are in, and moves members there as far as the target's
quota has room; where it has not, a share of the wish is granted.  A group
larger than a quota keeps the remainder where it is.  Documents without links
have no preference: they fill what is left, so the counts of any two shards
end at most one apart (law ``rows``).

The rounds run on (group, shard) counts, at most ``shards`` rows a group, so a
group of any size costs no more than that.  Documents meet the decision once,
by their rank inside the group, ranked in hash slices.  Only one row per shard
comes to the driver.  A null text counts as empty; repeated rows are documents
like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import prefix_sums, stored

SHARDS = 40
ROUNDS = 5
SIZE_OVERHEAD = 16


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(raw) + SIZE_OVERHEAD).cast("bigint").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.unhex(F.sha2(raw, 256)).alias("grp"),
    )


def _by_shard(df: DataFrame, shard: str, amount: str, shards: int) -> list[int]:
    sums = dict(df.groupBy(shard).agg(F.sum(amount)).collect())
    return [sums.get(s, 0) for s in range(shards)]


def propagate(counts: DataFrame, quotas: list[int], rounds: int = ROUNDS) -> DataFrame:
    """(grp, shard, n) after the moves; every group's total stays what it was."""
    shards = len(quotas)
    for step in range(rounds):
        target = counts.groupBy("grp").agg(F.max_by("shard", F.struct("n", -F.col("shard"))).alias("to"))
        wishes = counts.join(target, "grp").withColumn("wish", F.when(F.col("shard") != F.col("to"), F.col("n")))
        load = _by_shard(counts, "shard", "n", shards)
        wish = _by_shard(wishes.filter("wish > 0"), "to", "wish", shards)
        if not any(wish):
            break
        granted = [
            min(1.0, max(0, q - have) / w) if w else 0.0 for q, have, w in zip(quotas, load, wish, strict=True)
        ]
        if not any(granted):
            break
        share = F.element_at(F.array(*map(F.lit, granted)), F.col("to") + 1)
        luck = F.pmod(F.xxhash64("grp", "shard", F.lit(step)), F.lit(1 << 20)) / float(1 << 20)
        part = F.floor(F.col("wish") * share)
        drawn = F.when(luck < share, F.col("wish")).otherwise(0)
        moved = F.when(F.col("wish").isNull(), 0).when((share < 1) & (part == 0), drawn).otherwise(part)
        decided = wishes.withColumn("moved", moved.cast("bigint"))
        stay = decided.select("grp", "shard", (F.col("n") - F.col("moved")).alias("n"))
        go = decided.select("grp", F.col("to").alias("shard"), F.col("moved").alias("n"))
        counts = stored(
            stay.union(go).groupBy("grp", "shard").agg(F.sum("n").alias("n")).filter("n > 0"), "shards"
        )
    return counts


def assign_shards(
    docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row."""
    base = stored(_documents(docs, id_col, text_col), "shards")
    total = base.count()
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    groups = base.groupBy("grp").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("grp")
    linked = base.join(groups, "grp", "left_semi").withColumn("one", F.lit(1))
    start = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard")
    counts = stored(
        linked.select("grp", start).groupBy("grp", "shard").agg(F.count(F.lit(1)).alias("n")), "shards"
    )
    counts = propagate(counts, quotas, rounds)

    within = Window.partitionBy("grp").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    places = prefix_sums(counts, ["shard"], ["grp"], "n", "offset").withColumn(
        "low", F.coalesce(F.sum("n").over(within), F.lit(0))
    )
    ranked = prefix_sums(linked, ["grp"], ["doc_id", "size", "text_crc32"], "one", "rank")
    placed = (
        ranked.join(places.withColumnRenamed("grp", "g"), (F.col("grp") == F.col("g")))
        .filter((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("low") + F.col("n")))
        .withColumn("slot", F.col("offset") + F.col("rank") - F.col("low"))
    )
    quota = F.element_at(F.array(*map(F.lit, quotas)), F.col("shard") + 1)
    placed = placed.withColumn("kept", F.col("slot") < quota)
    columns = ["doc_id", "size", "text_crc32"]
    loads = _by_shard(counts, "shard", "n", shards)
    kept = [min(n, q) for n, q in zip(loads, quotas, strict=True)]
    ends = list(accumulate(q - k for q, k in zip(quotas, kept, strict=True)))

    loose = base.join(groups, "grp", "left_anti").select(*columns)
    spilled = placed.filter(~F.col("kept")).select(*columns)
    filler = prefix_sums(loose.union(spilled).withColumn("one", F.lit(1)), [], columns, "one", "rank")
    end = F.array(*map(F.lit, ends))
    shard = F.size(F.filter(end, lambda x: x <= F.col("rank")))
    starts = F.array(*[F.lit(e - (q - k)) for e, q, k in zip(ends, quotas, kept, strict=True)])
    filled = filler.withColumn("shard", shard.cast("int")).withColumn(
        "slot",
        F.element_at(F.array(*map(F.lit, kept)), F.col("shard") + 1)
        + F.col("rank")
        - F.element_at(starts, F.col("shard") + 1),
    )
    out = [*columns, F.col("shard").cast("int").alias("shard"), F.col("slot").cast("bigint").alias("slot")]
    return placed.filter("kept").select(*out).union(filled.select(*out))
