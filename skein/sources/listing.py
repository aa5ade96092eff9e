"""Listing pages to candidate rows with CSS selectors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.dates import flexible_date
from skein.functions.urls import absolutize, candidate_url
from skein.operators.listing import MAX_CANDIDATES, first_per_url
from skein.session import spread
from skein.sources.dom import TEXT, Node, normalize, parse, text_of, walk

MAX_SELECTOR_CHARS = 200
TITLE_CHARS = 120


class Compound(NamedTuple):
    tag: str
    tests: tuple[tuple[str, str, str], ...]
    nth: int


class SelectorError(ValueError):
    """A selector outside the supported subset."""


_PART = re.compile(
    r"""(?P<tag>^(?:[a-zA-Z][\w-]*|\*))|\.(?P<cls>-?[_a-zA-Z][\w-]*)|\#(?P<id>[\w-]+)
    |\[\s*(?P<attr>[\w-]+)\s*(?:=\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[\w-]+))\s*)?\]
    |:nth-of-type\(\s*(?P<nth>[1-9]\d*)\s*\)|:(?P<first>first-child)""",
    re.VERBOSE,
)
_TOKEN = re.compile(r"""(?:[^\s>\["']|\[[^\]]*\])+|\s*>\s*|\s+""")


def _compound(text: str) -> Compound:
    at, tag, tests, nth = 0, "*", [], 0
    while at < len(text):
        m = _PART.match(text, at)
        if m is None or m.end() == at:
            raise SelectorError(f"unsupported selector {text!r}")
        if m["tag"]:
            tag = m["tag"].lower()
        elif m["cls"]:
            tests.append(("class", "", m["cls"]))
        elif m["id"]:
            tests.append(("attr", "id", m["id"]))
        elif m["attr"]:
            value = next((m[g] for g in ("dq", "sq", "bare") if m[g] is not None), None)
            tests.append(("has", m["attr"].lower(), "") if value is None else ("attr", m["attr"].lower(), value))
        elif m["nth"]:
            nth = int(m["nth"])
        else:
            tests.append(("first", "", ""))
        at = m.end()
    return Compound(tag, tuple(tests), nth)


def compile_selector(text: str) -> list[list[tuple[str, Compound]]]:
    """Alternatives, each a list of (combinator, compound) from left to right."""
    if len(text) > MAX_SELECTOR_CHARS:
        raise SelectorError("selector too long")
    out = []
    for alternative in text.split(","):
        tokens = _TOKEN.findall(alternative.strip())
        if not tokens or "".join(tokens) != alternative.strip():
            raise SelectorError(f"unsupported selector {text!r}")
        steps, link = [], " "
        for token in tokens:
            if not token.strip() or token.strip() == ">":
                link = token.strip() or " "
                continue
            steps.append((link, _compound(token)))
            link = " "
        if not steps or tokens[-1].strip() == ">":
            raise SelectorError(f"unsupported selector {text!r}")
        out.append(steps)
    return out


def _siblings(node: Node) -> list[Node]:
    return [c for c in node.parent.children if c.tag != TEXT] if node.parent else [node]


def _fits(node: Node, c: Compound) -> bool:
    if c.tag not in ("*", node.tag):
        return False
    for kind, name, value in c.tests:
        if kind == "class" and value not in (node.get("class") or "").split():
            return False
        if kind == "attr" and node.get(name) != value:
            return False
        if kind == "has" and node.get(name) is None:
            return False
        if kind == "first" and _siblings(node)[0] is not node:
            return False
    if c.nth:
        same = [s for s in _siblings(node) if s.tag == node.tag]
        return len(same) >= c.nth and same[c.nth - 1] is node
    return True


def _matches_steps(node: Node, steps: list[tuple[str, Compound]], last: int) -> bool:
    link, compound = steps[last]
    if node.tag == TEXT or not _fits(node, compound):
        return False
    if last == 0:
        return True
    parent = node.parent
    while parent is not None:
        if _matches_steps(parent, steps, last - 1):
            return True
        if link == ">":
            return False
        parent = parent.parent
    return False


def matches(node: Node, selector: list[list[tuple[str, Compound]]]) -> bool:
    return any(_matches_steps(node, steps, len(steps) - 1) for steps in selector)


def _first(item: Node, selector: list | None) -> Node | None:
    if selector is None:
        return None
    return next((n for n, _ in walk(item) if matches(n, selector)), None)


def _links(node: Node) -> list[Node]:
    return [n for n, _ in walk(node) if n.tag == "a" and n.get("href")]


def _label(node: Node | None) -> str:
    return normalize(text_of(node)) if node is not None else ""


def _link_of(item: Node, selector: list | None) -> Node | None:
    """The item's link: by selector, itself, or its longest link text."""
    target = _first(item, selector) if selector is not None else item
    if target is None:
        return None
    if target.tag == "a":
        return target if target.get("href") else None
    found = _links(target)
    if selector is not None:
        return found[0] if found else None
    return max(found, key=lambda a: len(_label(a)), default=None)


def _outermost(root: Node, selector: list) -> list[Node]:
    out: list[Node] = []
    covered = -1
    for node, _ in walk(root):
        if node.pos > covered and matches(node, selector):
            out.append(node)
            covered = node.end
    return out


MATCH_SCHEMA = (
    "page_id {id}, pos int, matched int, href string, title string, date_text string, summary string, error string"
)
_MATCH_COLUMNS = [c.split()[0] for c in MATCH_SCHEMA.split(", ")]
SELECTORS = ["item_selector", "link_selector", "title_selector", "date_selector", "summary_selector"]


def _page_matches(page: int, html: str, selectors: list[str | None]) -> list[tuple]:
    try:
        item_sel, link_sel, title_sel, date_sel, summary_sel = (
            compile_selector(s) if s else None for s in selectors
        )
    except SelectorError as err:
        return [(page, None, 0, None, None, None, None, str(err))]
    if item_sel is None:
        return [(page, None, 0, None, None, None, None, "item_selector is required")]
    found = _outermost(parse(html), item_sel)
    if not found:
        return [(page, None, 0, None, None, None, None, "item_selector matched no elements")]
    out = []
    for i, item in enumerate(found[:MAX_CANDIDATES]):
        link = _link_of(item, link_sel)
        title = _label(_first(item, title_sel)) or _label(link) or _label(item)[:TITLE_CHARS]
        date = _first(item, date_sel)
        written = ((date.get("datetime") or "") if date.tag == "time" else "") or _label(date) if date else ""
        out.append(
            (page, i, len(found), link.get("href") if link else None, title, written,
             _label(_first(item, summary_sel)), None)
        )
    return out


def listing_matches(pages: DataFrame) -> DataFrame:
    """Item matches of (page_id, html, *_selector) pages, the first 500 per page.

    ``matched`` is the count before that limit; a page without a match or with
    a bad selector gives one row with ``error``.
    """

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False):
                out += _page_matches(row.page_id, row.html or "", [getattr(row, s) for s in SELECTORS])
            yield pd.DataFrame(out, columns=_MATCH_COLUMNS).astype({"pos": "Int32"})

    return spread(pages.select("page_id", "html", *SELECTORS), "page_id").mapInPandas(
        explode, MATCH_SCHEMA.format(id=dict(pages.dtypes)["page_id"])
    )


def candidates(matches: DataFrame, pages: DataFrame, now: int, same_host_only: bool = True) -> DataFrame:
    """Eligible links of each listing in document order, first copy of a URL.

    The page's own URL is left out.  Columns: page_id, pos, url, title,
    published_at, summary, n_duplicates, matched, truncated.
    """
    with_base = matches.filter("href IS NOT NULL").join(
        pages.select("page_id", F.col("url").alias("_base")), "page_id"
    )
    base = F.col("_base")
    # The UDF result is named before use: an expression that repeats it many
    # times would call it many times.
    found = (
        with_base.withColumn("_abs", absolutize(base, F.col("href")))
        .withColumn("url", candidate_url(base, F.col("_abs"), F.lit(same_host_only)))
        .filter(F.col("url").isNotNull() & ~F.col("url").eqNullSafe(candidate_url(base, base, F.lit(False))))
        .select(
            "page_id",
            "url",
            "pos",
            "title",
            flexible_date(F.col("date_text"), F.lit(now)).alias("published_at"),
            "summary",
            "matched",
            (F.col("matched") > MAX_CANDIDATES).alias("truncated"),
        )
    )
    return first_per_url(found, "page_id")


def listing_warnings(matches: DataFrame, cands: DataFrame) -> DataFrame:
    """(page_id, matched, without_link, duplicates) for a preview."""
    totals = matches.groupBy("page_id").agg(
        F.max("matched").alias("matched"),
        F.count_if(F.col("error").isNull() & F.col("href").isNull()).alias("without_link"),
    )
    folded = cands.groupBy("page_id").agg(F.sum("n_duplicates").alias("duplicates"))
    return totals.join(folded, "page_id", "left").fillna(0, ["duplicates"])
