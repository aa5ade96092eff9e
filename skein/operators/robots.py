"""robots.txt rules joined to URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def robots_lines(files: DataFrame) -> DataFrame:
    """Directive rows (origin, n, key, val) of (origin, body) files."""
    lines = files.select("origin", F.posexplode(F.split("body", "\n")).alias("n", "_raw"))
    line = F.regexp_replace(F.regexp_replace("_raw", "#.*$", ""), r"^\s+|\s+$", "")
    parts = lines.withColumn("_line", line).filter(F.contains("_line", F.lit(":")))
    return parts.select(
        "origin",
        "n",
        F.lower(F.trim(F.substring_index("_line", ":", 1))).alias("key"),
        F.regexp_replace("_line", r"^[^:]*:\s*", "").alias("val"),
    ).filter(F.col("key").isin("user-agent", "allow", "disallow"))


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """Rules of the group that applies to ``agent``: (origin, n, allow, pattern).

    The first group naming the agent wins, else the first naming ``*``.
    Consecutive user-agent lines share a group.  Everything is evaluated over
    one robots file, whose size a fetch bounds.
    """
    from pyspark.sql import Window

    in_file = Window.partitionBy("origin").orderBy("n")
    is_agent = F.col("key") == "user-agent"
    starts = is_agent & ~F.coalesce(F.lag("key").over(in_file) == "user-agent", F.lit(False))
    grouped = robots_lines(files).withColumn(
        "grp", F.sum(starts.cast("int")).over(in_file.rowsBetween(Window.unboundedPreceding, 0))
    ).filter("grp > 0")
    token = agent.lower()
    preference = F.when(F.lower("val") == token, 0).when(F.col("val") == "*", 1)
    chosen = (
        grouped.filter(is_agent & preference.isNotNull())
        .groupBy("origin")
        .agg(F.min(F.struct(preference.alias("p"), "grp")).alias("_c"))
        .select("origin", F.col("_c.grp").alias("grp"))
    )
    return (
        grouped.filter(~is_agent & (F.col("val") != ""))
        .join(chosen, ["origin", "grp"])
        .select("origin", "n", (F.col("key") == "allow").alias("allow"), F.col("val").alias("pattern"))
    )


def rule_regex(pattern: Column) -> Column:
    """A regex with the rule's matching: literal runs found leftmost, in order.

    Atomic groups keep a later run from being retried elsewhere, so
    ``/*.php$`` rejects ``/a.php.php``.
    """
    anchored = F.endswith(pattern, F.lit("$"))
    bare = F.regexp_replace(pattern, r"\$$", "")
    escaped = F.transform(
        F.filter(F.transform(F.split(bare, r"\*"), lambda s, i: F.struct(s.alias("s"), i.alias("i"))),
                 lambda r: r["s"] != ""),
        lambda r: F.concat(
            F.when(r["i"] == 0, "(?>").otherwise("(?>.*?"),
            F.regexp_replace(r["s"], r"([\\.+?^${}()|\[\]*])", r"\\$1"),
            F.lit(")"),
        ),
    )
    body = F.concat(F.lit("(?s)^"), F.array_join(escaped, ""))
    return F.when(bare == "", F.when(anchored, "^$").otherwise("")).otherwise(
        F.concat(body, F.when(anchored, r"\z").otherwise(""))
    )


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` with ``allowed``: the longest matching rule decides, ties by order.

    Only URLs of an origin that has rules are joined; all others are allowed.
    """
    split = urls.withColumn("origin", F.regexp_extract("url", "^(?i)(https?://[^/?#]*)", 1)).withColumn(
        "_path", F.regexp_extract("url", "^(?i)https?://[^/?#]*([^?#]*)", 1)
    )
    matched = split.join(
        rules.select("origin", "n", "allow", "pattern", rule_regex(F.col("pattern")).alias("_re")), "origin"
    ).filter(F.rlike("_path", "_re"))
    verdict = matched.groupBy("url").agg(
        F.min_by("allow", F.struct((-F.octet_length("pattern")).alias("l"), "n")).alias("_allow")
    )
    return (
        urls.join(verdict, "url", "left")
        .withColumn("allowed", F.coalesce("_allow", F.lit(True)))
        .drop("_allow")
    )
