"""Quality rules by distribution divergence, in DataFrame functions only.

Each text gives two histograms: of character classes, and of the common words
of its language.  The reference of a language is the sum of both over all its
documents that pass the base rules; a document is kept if its Jensen-Shannon
distance (base 2, 0 to 1) from the reference stays within the limits.  The
character limit is fixed.  The word limit is a share of the distance at which a
text without any common word stands, which follows from how common the common
words of that reference are; a text whose words are nearer to the reference of
another language goes as well.  The character test needs ``MIN_CHARS`` counted
characters, the word test ``MIN_TOKENS`` words read, common or not; below that
the test passes, for a short text says too little.  A language without word
list, or whose reference rests on fewer than ``MIN_REFERENCE`` words, keeps the
base verdict.

References are at most one short row per listed language and come to the
driver; everything else stays in rows.  Null and empty texts have no words and
fail the base rule.  Only id, text and language are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import stored

# Common words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that for it was on are as with be at by this from or an not have he but".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur avec il".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al como más".split(),
}
# Character classes; what none of them takes is the last class.
CHAR_CLASSES = {
    "lower": r"[a-z]+",
    "space": r"[\x20\x09-\x0D]+",
    "letter_other": r"[\p{L}&&[^a-zA-Z]]+",
    "upper": r"[A-Z]+",
    "point": r"[.,;:'\x22?()-]+",
    "digit": r"[0-9]+",
    "mark": r"[#*$%&|<>!]+",
}
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_CHAR_DISTANCE = 0.3
MIN_CHARS = 300
MIN_TOKENS = 50
# Fixed values: (words read, share of a word-free text's distance) of the word limit; fewer words scatter more.
WORD_LIMITS = ((100, 0.8), (MIN_TOKENS, 0.9))
MIN_REFERENCE = 1000


def _repeat_words(words: str) -> Column:
    """Words covered by a 3-word window that the text holds more than once."""
    w, last = F.col(words), F.size(words) - 3
    spots = F.sequence(F.lit(0), last)
    hashes = F.transform(spots, lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
    return F.when(last < 1, F.lit(False)).otherwise(F.size(F.array_distinct(hashes)) < last + 1)


def _repeat_count(words: str, windows: str) -> tuple[Column, Column]:
    """Sorted (window, position) pairs, and the covered words counted from them."""
    w = F.col(words)
    pairs = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), F.size(words) - 3),
            lambda i: F.struct(F.concat_ws(" ", w[i], w[i + 1], w[i + 2]).alias("g"), i.alias("i")),
        )
    )
    s, end = F.col(windows), F.size(windows) - 1
    twice = F.filter(
        F.sequence(F.lit(0), end),
        lambda k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["g"] == s[k]["g"]))
        | ((k < end) & (s[F.least(k + 1, end)]["g"] == s[k]["g"])),
    )
    covered = F.array_distinct(
        F.flatten(F.transform(twice, lambda k: F.array(s[k]["i"], s[k]["i"] + 1, s[k]["i"] + 2)))
    )
    return pairs, F.size(covered)


def base_measures(docs: DataFrame, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    """doc_id, lang, text, n_words and the base counts of every row."""
    lang = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    start = docs.select(
        F.col(id_col).alias("doc_id"), lang.alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    words = start.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    measured = (
        words.withColumn("lines", lines)
        .withColumn("n_words", F.size("words").cast("bigint"))
        .withColumn("word_chars", F.length(F.array_join("words", "")).cast("bigint"))
        .withColumn("n_symbols", F.length(F.regexp_replace("text", SYMBOLS, "")).cast("bigint"))
        .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"))
        .withColumn("again", _repeat_words("words"))
    )
    pairs, _ = _repeat_count("words", "pairs")
    measured = measured.withColumn("pairs", F.when(F.col("again"), pairs))
    _, covered = _repeat_count("words", "pairs")
    measured = measured.withColumn("n_repeat_words", F.when(F.col("again"), covered).otherwise(0).cast("bigint"))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return measured.withColumn("base_failed", failed).drop("words", "lines", "again", "pairs")


def _char_histogram(df: DataFrame) -> DataFrame:
    """Class counts: each class is stripped from what the earlier ones left."""
    rest, counts = "text", []
    for i, pattern in enumerate(CHAR_CLASSES.values()):
        df = df.withColumn(f"rest{i}", F.regexp_replace(rest, pattern, ""))
        counts.append(F.length(rest) - F.length(f"rest{i}"))
        rest = f"rest{i}"
    df = df.withColumn("chars", F.array(*counts, F.length(rest)))
    return df.drop(*[f"rest{i}" for i in range(len(CHAR_CLASSES))])


EVERY = sorted({w for words in COMMON_WORDS.values() for w in words})


def _word_histogram(df: DataFrame) -> DataFrame:
    """Counts of the common words of all languages in the order of ``EVERY``, and of all words."""
    df = df.withColumn("tokens", F.array_remove(F.split(F.lower("text"), r"[^\p{L}]+"), ""))
    found = F.filter("tokens", lambda w: w.isin(EVERY))
    df = df.withColumn("found", F.concat(F.lit(" "), F.array_join(found, "  "), F.lit(" ")))
    df = df.withColumn("n_tokens", F.size("tokens")).drop("tokens")
    counts = [
        ((F.length("found") - F.length(F.replace("found", F.lit(f" {w} ")))) / (len(w) + 2)).cast("int")
        for w in EVERY
    ]
    return df.withColumn("every", F.array(*counts)).drop("found")


def _common(lang: str) -> Column:
    """Counts of the language's common words in list order, then of all other words."""
    counts = F.transform(F.array(*[F.lit(EVERY.index(w)) for w in COMMON_WORDS[lang]]), lambda i: F.col("every")[i])
    others = F.col("n_tokens") - F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    return F.concat(counts, F.array(others))


def _distance(counts: str | Column, reference: Column) -> Column:
    """Jensen-Shannon distance of a count array from a frequency array."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    shares = F.transform(counts, lambda x: x / F.greatest(total, F.lit(1.0)))

    def part(p: Column, q: Column) -> Column:
        half = (p + q) / 2
        left = F.when(p > 0, p * F.log2(p / half)).otherwise(0.0)
        return left + F.when(q > 0, q * F.log2(q / half)).otherwise(0.0)

    divergence = F.aggregate(F.zip_with(shares, reference, part), F.lit(0.0), lambda a, x: a + x) / 2
    return F.sqrt(F.greatest(divergence, F.lit(0.0)))


def _word_free_distance(reference: list[float]) -> float:
    """Distance from a reference at which a text without any common word stands."""
    others = reference[-1]
    left = math.log2(2 / (1 + others)) + (others * math.log2(2 * others / (1 + others)) if others else 0.0)
    return math.sqrt((1 - others + left) / 2)


def references(measured: DataFrame) -> dict[str, dict[str, list[float]]]:
    """Histogram shares per listed language over its documents that pass the base rules."""
    sound = measured.filter(~F.col("base_failed") & F.col("lang").isin(list(COMMON_WORDS)))
    common = F.lit(None).cast("array<int>")
    for lang in COMMON_WORDS:
        common = F.when(F.col("lang") == lang, _common(lang)).otherwise(common)
    cells = sound.select(
        "lang", F.explode(F.array(F.lit("chars"), F.lit("common"))).alias("kind"), "chars", common.alias("common")
    ).select("lang", "kind", F.posexplode(F.when(F.col("kind") == "chars", F.col("chars")).otherwise(F.col("common"))))
    sums = cells.groupBy("lang", "kind", "pos").agg(F.sum("col").alias("n")).collect()
    grouped: dict[str, dict[str, dict[int, int]]] = {}
    for r in sums:
        grouped.setdefault(r["lang"], {}).setdefault(r["kind"], {})[r["pos"]] = r["n"]
    out = {}
    for lang, kinds in grouped.items():
        if sum(kinds["common"].values()) >= MIN_REFERENCE:
            out[lang] = {
                k: [kinds[k][i] / max(1, sum(kinds[k].values())) for i in range(len(kinds[k]))] for k in kinds
            }
    return out


def measure(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang"
) -> DataFrame:
    """Base counts, both distances (null where no test applies) and the verdict of every row."""
    full = _word_histogram(_char_histogram(base_measures(docs, id_col, text_col, lang_col))).drop("text")
    full = stored(full, "quality")
    refs = references(full)

    def own(value: Callable[[str], Column], type_: str) -> Column:
        chosen = F.lit(None).cast(type_)
        for lang in sorted(refs):
            chosen = F.when(F.col("lang") == lang, value(lang)).otherwise(chosen)
        return chosen

    def word_limit(lang: str) -> Column:
        limit = F.lit(None).cast("double")
        for least, share in reversed(WORD_LIMITS):
            limit = F.when(F.col("n_tokens") >= least, share * _word_free_distance(refs[lang]["common"])).otherwise(limit)
        return limit

    def others(lang: str) -> Column:
        return F.array(*[F.col(f"words_{other}") for other in sorted(refs) if other != lang]).cast("array<double>")

    full = full.withColumn("char_ref", own(lambda lang: F.array(*map(F.lit, refs[lang]["chars"])), "array<double>"))
    long_enough = F.aggregate("chars", F.lit(0), lambda a, x: a + x) >= MIN_CHARS
    full = full.withColumn(
        "char_distance", F.when(F.col("char_ref").isNotNull() & long_enough, _distance("chars", F.col("char_ref")))
    )
    tested = F.col("lang").isin(sorted(refs)) & (F.col("n_tokens") >= MIN_TOKENS)
    names = [f"words_{lang}" for lang in sorted(refs)]
    for lang, name in zip(sorted(refs), names, strict=True):
        shares = F.array(*map(F.lit, refs[lang]["common"]))
        full = full.withColumn(name, F.when(tested, _distance(_common(lang), shares)))
    full = full.withColumn("word_distance", own(lambda lang: F.col(f"words_{lang}"), "double"))
    diverges = (
        (F.coalesce("char_distance", F.lit(0.0)) > MAX_CHAR_DISTANCE)
        | F.coalesce(F.col("word_distance") > own(word_limit, "double"), F.lit(False))
        | F.coalesce(F.col("word_distance") > F.array_min(own(others, "array<double>")), F.lit(False))
    )
    return full.withColumn("kept", ~F.col("base_failed") & ~diverges).drop(
        "chars", "every", "n_tokens", "char_ref", *names
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text passes, all columns as they were."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    carried = docs.select(
        row.alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")
    )
    keyed = carried.withColumn("_key", F.xxhash64("_id", "_text", "_lang"))
    judged = measure(keyed.select("_key", "_text", "_lang"), "_key", "_text", "_lang")
    good = judged.filter("kept").select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(good, "_key", "left_semi").select("_row.*")

