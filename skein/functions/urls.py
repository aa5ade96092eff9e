"""URL expressions."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Click-tracking query parameters dropped from a canonical URL.
TRACKING_PREFIX = "utm_"
TRACKING_PARAMS = ("fbclid", "gclid", "_ga", "mc_cid", "mc_eid")

# Pseudo-schemes marking a subscription that is not a real feed.
KIND_PREFIXES = {"pagewatch": "pagewatch:", "selector": "selector:"}


def _join(base: str | None, ref: str | None) -> str | None:
    if ref is None:
        return None
    try:
        joined = urljoin(base or "", ref)
        urlsplit(joined)
        return joined
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def absolutize(base: pd.Series, ref: pd.Series) -> pd.Series:
    """RFC 3986 reference resolution; null when the reference cannot be parsed."""
    return pd.Series([_join(b, r) for b, r in zip(base, ref, strict=True)], dtype="object")


def is_absolute_http(url: Column) -> Column:
    return url.rlike("^(?i:https?)://[^/?#]")


def resolve_url(base: Column, ref: Column) -> Column:
    """Absolute http(s) URL of ``ref`` against ``base``, or '' if there is none."""
    joined = absolutize(base, ref)
    return F.when(F.coalesce(ref, F.lit("")) == "", "").otherwise(
        F.when(joined.rlike("^(?i:https?):"), joined).otherwise("")
    )


def _escape(value: Column) -> Column:
    # URLEncoder and Go's QueryEscape differ on these two characters only.
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """Drop tracking parameters and re-encode the rest sorted by key.

    For absolute URLs; resolve relative ones first.  A URL without a query is
    returned unchanged, and values keep their order within a key.
    """
    head = F.regexp_extract(url, r"^([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"(#.*)$", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.contains(p, F.lit(";")))
    decoded = F.transform(
        pairs,
        lambda p, i: F.struct(
            F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"),
            i.alias("i"),
            F.try_url_decode(
                F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")
            ).alias("v"),
        ),
    )
    kept = F.filter(
        decoded,
        lambda s: s["k"].isNotNull()
        & s["v"].isNotNull()
        & ~F.startswith(s["k"], F.lit(TRACKING_PREFIX))
        & ~s["k"].isin(*TRACKING_PARAMS),
    )
    encoded = F.array_join(
        F.transform(F.array_sort(kept), lambda s: F.concat(_escape(s["k"]), F.lit("="), _escape(s["v"]))),
        "&",
    )
    rebuilt = F.concat(head, F.when(encoded != "", F.concat(F.lit("?"), encoded)).otherwise(""), fragment)
    return F.when(query == "", url).otherwise(rebuilt)


def host_of(url: Column) -> Column:
    """Host name without port or credentials; null when there is none."""
    return F.try_parse_url(url, F.lit("HOST"))


def host_key(url: Column) -> Column:
    """Lower-case host without a leading ``www.``, for same-site tests."""
    return F.regexp_replace(F.lower(host_of(url)), r"^www\.", "")


def candidate_url(base: Column, url: Column, same_host_only: Column) -> Column:
    """Canonical listing candidate: http(s), no fragment, optionally same host.

    Null when the link is not eligible.
    """
    clean = F.regexp_replace(canonical_url(url), "#.*$", "")
    ok = clean.rlike("^(?i:https?):") & (~same_host_only | (host_key(clean) == host_key(base)))
    return F.when(ok, clean)


def feed_kind(feed_url: Column) -> Column:
    out = F.lit("feed")
    for kind, prefix in KIND_PREFIXES.items():
        out = F.when(F.startswith(feed_url, F.lit(prefix)), kind).otherwise(out)
    return out


def feed_target(feed_url: Column) -> Column:
    """The real URL behind a pseudo-scheme, or the URL itself."""
    return F.regexp_replace(feed_url, "^(" + "|".join(KIND_PREFIXES.values()) + ")", "")


def path_tail(url: Column) -> Column:
    """Last path segment, unescaped; the whole URL when the path is empty."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    raw = F.element_at(F.split(F.regexp_replace(path, "/$", ""), "/"), -1)
    # PathUnescape leaves '+' alone while the form decoder would blank it.
    tail = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    return F.when(tail == "", url).otherwise(tail)


def product_token(user_agent: Column) -> Column:
    return F.regexp_extract(user_agent, "^[^/ ]*", 0)


def favicon_url(url: Column, size: int = 16) -> Column:
    domain = F.coalesce(host_of(url), url)
    return F.concat(
        F.lit(f"https://www.google.com/s2/favicons?sz={size}&domain="),
        F.replace(F.url_encode(domain), F.lit("+"), F.lit("%20")),
    )


def display_title(title: Column, url: Column) -> Column:
    """Page title, else host name, else the URL."""
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(host_of(url), F.lit("")), url)
