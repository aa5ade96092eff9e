"""Text expressions: SQLite matching rules, normalization, hashing, masking."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"

MAX_BODY_BYTES = 512 << 10
MAX_IGNORE_PATTERN_CHARS = 1000

# Go's unicode.IsSpace set, which includes NEL, NBSP and the Unicode spaces.
GO_SPACE = "[\\t\\n\\u000B\\f\\r \\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"


def ascii_lower(text: Column) -> Column:
    """Fold A-Z only, the case rule of SQLite ``LIKE``.

    ``translate`` walks characters one by one, so pure ASCII text takes the
    byte-wise ``lower`` instead.
    """
    return F.when(is_ascii(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def like_contains_folded(text: Column, word: Column) -> Column:
    """``text LIKE '%word%'`` for operands already passed through ascii_lower.

    ``%`` and ``_`` inside the word stay wildcards and nothing is an escape
    character.  Most words hold no wildcard, so the usual path is ``contains``.
    """
    pattern = F.concat(F.lit("%"), F.replace(word, F.lit("\\"), F.lit("\\\\")), F.lit("%"))
    return F.when(word.rlike("[%_]"), F.like(text, pattern)).otherwise(F.contains(text, word))


def like_probe(word: Column) -> Column:
    """A literal that ``lower(text)`` must contain wherever ``word`` can match.

    The longest run of the word between wildcards, lower-cased.  A word with a
    capital sigma, whose lower case depends on its neighbours, gets the empty
    probe, which every text contains.
    """
    runs = F.transform(F.split(word, "[%_]"), lambda r: F.struct(F.char_length(r).alias("n"), r.alias("r")))
    return F.when(F.contains(word, F.lit("Σ")), "").otherwise(F.lower(F.array_max(runs)["r"]))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def folds_plainly(text: Column) -> Column:
    """Whether ``lower`` and the A-Z fold agree wherever ASCII letters result.

    Only the Kelvin sign and the dotted capital I lower-case to ASCII letters.
    """
    return ~F.contains(text, F.lit("\u212a")) & ~F.contains(text, F.lit("\u0130"))


def like_word(folded: Column) -> Column:
    """Everything a LIKE test needs to know about a folded word, computed once."""
    probe = like_probe(folded)
    wild = folded.rlike("[%_]")
    return F.struct(
        folded.alias("word"),
        probe.alias("probe"),
        is_ascii(folded).alias("ascii"),
        # On plainly folding text the probe alone decides these words.
        (is_ascii(folded) & ~wild & (probe == folded)).alias("simple"),
    )


def like_contains_word(text: Column, lowered: Column, plain: Column, word: Column) -> Column:
    """LIKE test of a :func:`like_word` against text with its ``lower`` at hand.

    The probe decides almost all pairs; of the rest an ASCII word is matched
    on the lower-cased text and only other words pay for the exact fold.
    """
    exact = F.when(plain & word["ascii"], like_contains_folded(lowered, word["word"])).otherwise(
        like_contains_folded(ascii_lower(text), word["word"])
    )
    return F.contains(lowered, word["probe"]) & ((plain & word["simple"]) | exact)


def like_contains(text: Column, word: Column) -> Column:
    """``text LIKE '%' || word || '%'`` under SQLite rules."""
    return like_contains_word(text, F.lower(text), folds_plainly(text), like_word(ascii_lower(word)))


def literal_contains(text: Column, needle: Column) -> Column:
    """Case-insensitive literal substring test (searches of 3+ characters)."""
    return F.contains(F.lower(text), F.lower(needle))


def trim_space(text: Column) -> Column:
    """Trim every kind of whitespace, not only blanks."""
    return F.regexp_replace(text, f"^{GO_SPACE}+|{GO_SPACE}+$", "")


def collapse_space(text: Column) -> Column:
    """Collapse whitespace runs to one blank and trim; no Unicode folding."""
    return F.trim(F.regexp_replace(text, GO_SPACE + "+", " "))


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def normalize_text(text: Column) -> Column:
    """NBSP and U+3000 to blank, NFKC, collapse whitespace, trim.

    Spark has no Unicode normalizer, so text with any non-ASCII character goes
    through an Arrow UDF.
    """
    return collapse_space(_nfkc(text))


def strip_tags(html: Column) -> Column:
    """Remove every ``<...>`` run and trim whitespace."""
    return trim_space(F.regexp_replace(html, "<[^>]*>", ""))


def truncate_chars(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit)


@F.pandas_udf(T.StringType())
def _cut_utf8(text: pd.Series, limit: pd.Series) -> pd.Series:
    def cut(s: str | None, n: int) -> str | None:
        if s is None:
            return None
        raw = s.encode("utf-8", "surrogatepass")
        return s if len(raw) <= n else raw[:n].decode("utf-8", "ignore")

    return pd.Series([cut(s, int(n)) for s, n in zip(text, limit, strict=True)])


def truncate_utf8(text: Column, limit: int = MAX_BODY_BYTES) -> Column:
    """At most ``limit`` bytes of UTF-8, never splitting a character."""
    return F.when(F.octet_length(text) <= limit, text).otherwise(_cut_utf8(text, F.lit(limit)))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def mask_patterns(html: Column, patterns: Column) -> Column:
    """Delete every match of each pattern of an array column, in order."""
    return F.aggregate(
        F.coalesce(patterns, F.array().cast("array<string>")),
        html,
        lambda acc, p: F.regexp_replace(acc, p, F.lit("")),
    )


_META = r"([.*+?^${}()|\[\]\\])"


def ignore_pattern(text: Column) -> Column:
    """A reusable pattern for a block's text: escaped, digit runs generalized."""
    escaped = F.regexp_replace(trim_space(text), _META, r"\\$1")
    return F.substring(F.regexp_replace(escaped, "[0-9]+", r"\\d+"), 1, MAX_IGNORE_PATTERN_CHARS)


def highlight_segments(text: Column, query: Column) -> Column:
    """Array of (text, match) pieces splitting ``text`` at each literal match."""
    q = trim_space(query)
    pattern = F.concat(F.lit("(?iu)"), F.regexp_replace(q, _META, r"\\$1"))
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, pattern, -1)

    # Zipping evaluates both arrays once; indexing one from a lambda would not.
    def piece(pair: Column) -> Column:
        return F.array(
            F.struct(pair["gap"].alias("text"), F.lit(False).alias("match")),
            F.struct(pair["hit"].alias("text"), F.lit(True).alias("match")),
        )

    pairs = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))
    pieces = F.filter(F.flatten(F.transform(pairs, piece)), lambda s: F.coalesce(s["text"], F.lit("")) != "")
    whole = F.array(F.struct(text.alias("text"), F.lit(False).alias("match")))
    return F.when((q == "") | (F.size(pieces) == 0), whole).otherwise(pieces)


def anonymize_text(text: Column, keep: list[str] | None = None) -> Column:
    """Replace letters and digits by one stand-in per character class."""
    masked = text
    for pattern, stand_in in (
        (r"\p{IsHiragana}", "あ"),
        (r"\p{IsKatakana}", "ア"),
        (r"\p{IsHan}", "亜"),
        ("[a-z]", "a"),
        ("[A-Z]", "A"),
        ("[0-9]", "0"),
    ):
        masked = F.regexp_replace(masked, pattern, stand_in)
    for pattern in keep or []:
        masked = F.when(text.rlike(pattern), text).otherwise(masked)
    return masked


def is_anonymized(text: Column) -> Column:
    """Whether only stand-ins remain for every masked character class."""
    return ~text.rlike(r"[b-zB-Z1-9]|[\p{IsHan}&&[^亜]]|[\p{IsHiragana}&&[^あ]]|[\p{IsKatakana}&&[^ア]]")
