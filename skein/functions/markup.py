"""Column tests on element attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that never hold page content.
DROP_ALWAYS = (
    "script", "style", "noscript", "template", "svg", "canvas", "iframe", "object", "embed",
    "form", "input", "button", "select", "textarea", "label", "aside",
)
# Landmarks dropped only near the top of the page.
DROP_NEAR_TOP = ("header", "footer", "nav")
LANDMARK_DEPTH = 3
# ARIA roles that mark page chrome.
NOISE_ROLES = ("banner", "navigation", "contentinfo", "complementary", "search", "dialog", "alert")
# Whole words of class and id values that mark page chrome.
NOISE_WORDS = (
    "nav", "navi", "navigation", "menu", "gnav", "gnavi", "breadcrumb", "breadcrumbs",
    "sidebar", "side", "aside", "footer", "header", "banner", "ad", "ads", "advertisement",
    "sns", "share", "social", "comment", "comments", "related", "recommend", "ranking",
    "pagination", "pager", "cookie", "cookiebar", "gotop", "pagetop", "skip",
    "lastmod", "lastmodified", "docid", "counter", "access",
)
# Elements that become content blocks.
BLOCK_TAGS = (
    "p", "li", "tr", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6",
    "blockquote", "pre", "figcaption", "td", "th", "section", "article", "div",
)
HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def _words(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def has_noise_word(value: Column) -> Column:
    words = F.split(F.lower(F.coalesce(value, F.lit(""))), r"[-_ \t\n]+")
    return F.arrays_overlap(words, _words(NOISE_WORDS))


def has_noise_role(value: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(F.coalesce(value, F.lit(""))), r"\s+"), _words(NOISE_ROLES))


def is_hidden(attrs: Column) -> Column:
    style = F.replace(F.lower(F.coalesce(attrs["style"], F.lit(""))), F.lit(" "), F.lit(""))
    return (
        F.map_contains_key(attrs, "hidden")
        | (F.lower(F.coalesce(attrs["aria-hidden"], F.lit(""))) == "true")
        | F.contains(style, F.lit("display:none"))
        | F.contains(style, F.lit("visibility:hidden"))
    )


def is_noise(tag: Column, depth: Column, attrs: Column) -> Column:
    """Whether an element starts a subtree of chrome; depth counts from body."""
    return (
        tag.isin(*DROP_ALWAYS)
        | (tag.isin(*DROP_NEAR_TOP) & (depth <= LANDMARK_DEPTH))
        | has_noise_role(attrs["role"])
        | has_noise_word(attrs["class"])
        | has_noise_word(attrs["id"])
        | is_hidden(attrs)
    )


def is_stable_class(name: Column) -> Column:
    """False for class names that look generated."""
    generated = (
        name.rlike("^[0-9]+$")
        | name.rlike("^(?i)[0-9a-f]{6,}$")
        | name.rlike("^[a-zA-Z][A-Za-z0-9_]*[-_][0-9a-f]{5,}$")
    )
    return (name != "") & ~generated


def stable_signature(tag: Column, classes: Column) -> Column:
    """Tag plus sorted stable classes: one template, one signature."""
    stable = F.array_sort(F.filter(classes, is_stable_class))
    return F.concat(tag, F.lit("."), F.array_join(stable, "."))
