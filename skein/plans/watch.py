"""Watching pages: new page versions against the saved baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import blocks
from skein.operators.pagedom import page_blocks, page_titles
from skein.session import cut_lineage
from skein.sources.dom import dom_rows

BY = ["source_id"]
BASELINE = ["source_id", "pos", "key", "html", "anchor", "head"]

# Default settings of a watched page.
DEFAULTS = {
    "ignore_patterns": F.array, "min_change_chars": 0, "watch_mode": "additions",
    "include_full_body": True, "guid_mode": "content",
}


def with_defaults(sources: DataFrame) -> DataFrame:
    """Fill unset settings of (source_id, url, ...) rows."""
    out = sources
    kinds = {
        "ignore_patterns": "array<string>", "min_change_chars": "int", "watch_mode": "string",
        "include_full_body": "boolean", "guid_mode": "string",
    }
    for name, kind in kinds.items():
        default = F.array() if name == "ignore_patterns" else F.lit(DEFAULTS[name])
        have = F.col(name) if name in sources.columns else F.lit(None)
        out = out.withColumn(name, F.coalesce(have.cast(kind), default.cast(kind)))
    return out


def watch_round(
    sources: DataFrame, pages: DataFrame, baselines: DataFrame, runs: DataFrame, now: int
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One poll of every source.

    ``sources`` (source_id, url, settings...), ``pages`` (source_id, html),
    ``baselines`` saved block rows, ``runs`` (source_id, rules_version,
    config_hash) of the last save.  Returns (entries, new baselines, new runs,
    decisions).  A source without a page this round keeps its baseline.
    """
    src = with_defaults(sources).withColumn("config_hash", F.sha2(F.to_json("ignore_patterns"), 256))
    polled = pages.select(F.col("source_id").alias("page_id"), "html").join(
        src.select(F.col("source_id").alias("page_id"), "url"), "page_id"
    )
    nodes = cut_lineage(dom_rows(polled))
    titles = page_titles(nodes).withColumnRenamed("page_id", "source_id")
    settings = src.join(titles, "source_id", "left").withColumn("page_title", F.coalesce("page_title", F.lit("")))
    found = page_blocks(nodes, polled).withColumnRenamed("page_id", "source_id")
    masks = src.select("source_id", "ignore_patterns")
    current = cut_lineage(
        blocks.comparable(found.join(masks, "source_id"), F.col("ignore_patterns")).drop("ignore_patterns")
    )

    # Baselines are re-masked only where the patterns changed since the save.
    changed = runs.select("source_id", F.col("config_hash").alias("_was"))
    old = baselines.join(masks, "source_id").join(
        src.select("source_id", "config_hash"), "source_id"
    ).join(changed, "source_id")
    same_config = old.filter(F.col("_was") == F.col("config_hash")).withColumn("can_remask", F.lit(True))
    moved = blocks.remask_state(
        old.filter(F.col("_was") != F.col("config_hash")), BY, F.col("ignore_patterns")
    )
    keep = [*BASELINE, "can_remask"]
    prev = same_config.select(*keep).unionByName(moved.select(*keep)).withColumn(
        "text", F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", "")
    )

    shape = ["source_id", "pos", "key", "html", "text"]
    diff = cut_lineage(blocks.aligned_diff(prev.select(*shape), current.select(*shape), BY))
    old_hash = prev.groupBy("source_id").agg(
        F.sha2(blocks.joined_in_order("key"), 256).alias("prev_hash"), F.min("can_remask").alias("can_remask")
    )
    # A page whose blocks all mask away still has a hash: that of no keys.
    new_hash = blocks.content_hashes(current, BY).withColumnRenamed("content_hash", "new_hash")
    empty = F.sha2(F.lit(""), 256)
    facts = (
        found.select("source_id").distinct()
        .join(settings, "source_id")
        .join(new_hash, "source_id", "left")
        .join(old_hash, "source_id", "left")
        .join(runs.select("source_id", F.col("rules_version").alias("prev_rules")), "source_id", "left")
        .join(blocks.diff_summary(diff, BY), "source_id", "left")
        .withColumns({
            "has_state": F.col("prev_rules").isNotNull(),
            "state_valid": F.lit(True),
            "can_remask": F.coalesce("can_remask", F.lit(True)),
            "prev_hash": F.coalesce("prev_hash", empty),
            "new_hash": F.coalesce("new_hash", empty),
            "n_added": F.coalesce("n_added", F.lit(0)),
            "n_removed": F.coalesce("n_removed", F.lit(0)),
            "changed_chars": F.coalesce("changed_chars", F.lit(0)),
        })
        .withColumn("decision", blocks.watch_decision())
    )
    decisions = cut_lineage(facts)

    shown = diff.join(decisions.select("source_id", "watch_mode"), "source_id").filter(
        (F.col("change") == "added") | (F.col("watch_mode") == "changes")
    )
    bodies = blocks.render_changes(shown.drop("watch_mode"), BY).select("source_id", F.col("body").alias("_diff"))
    full = blocks.full_page_section(found, BY)
    decided = F.col("decision")
    body = F.concat(
        F.when(decided == blocks.STARTED, F.lit(blocks.STARTED_BODY)).otherwise(F.coalesce("_diff", F.lit(""))),
        F.when(F.col("include_full_body"), F.coalesce("full_body", F.lit(""))).otherwise(""),
    )
    entries = (
        decisions.filter(blocks.emits_entry(decided))
        .join(bodies, "source_id", "left")
        .join(full, "source_id", "left")
        .select(
            "source_id",
            blocks.entry_guid(F.col("guid_mode"), F.col("url"), F.col("new_hash"), now).alias("guid"),
            "url",
            blocks.entry_title(F.col("page_title"), F.col("url"), decided, now).alias("title"),
            body.alias("body"),
            F.lit(now).cast("bigint").alias("published_at"),
        )
    )
    saved = decisions.filter(blocks.saves_state(decided)).select("source_id")
    fresh = blocks.bounded_state(current.join(saved, "source_id", "left_semi").select(*BASELINE), BY)
    new_baselines = baselines.select(*BASELINE).join(saved, "source_id", "left_anti").unionByName(fresh)
    new_runs = runs.select("source_id", "rules_version", "config_hash").join(
        saved, "source_id", "left_anti"
    ).unionByName(
        src.join(saved, "source_id", "left_semi").select(
            "source_id", F.lit(blocks.RULES_VERSION).alias("rules_version"), "config_hash"
        )
    )
    return entries, new_baselines, new_runs, decisions.select("source_id", "decision")
