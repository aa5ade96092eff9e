"""Page content from DOM rows: noise removal, blocks, articles, dates, links.

Inputs come from :func:`skein.sources.dom.dom_rows`.  Every window is per page,
and a page's rows are bounded by the size of one fetched document.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.dates import flexible_date
from skein.functions.markup import BLOCK_TAGS, HEADING_TAGS, is_noise
from skein.functions.text import GO_SPACE, anonymize_text, is_anonymized, normalize_text
from skein.functions.urls import absolutize, canonical_url, resolve_url
from skein.operators.blocks import MAX_BLOCKS, with_heading_context
from skein.session import cut_lineage
from skein.sources.dom import TEXT, VOID_TAGS, WRITTEN

# Media types of feeds in <link rel="alternate">.
FEED_TYPES = ("application/rss+xml", "application/atom+xml", "application/json", "application/feed+json")
# JSON-LD types that describe an article.
ARTICLE_TYPES = ("Article", "NewsArticle", "BlogPosting")
# The display-safe subset of elements for structural inspection.
INSPECT_TAGS = tuple(
    "div span p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tr th td article section header "
    "footer nav aside main figure figcaption time a strong em b i small br hr style img".split()
)


def _upto() -> WindowSpec:
    return Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)


def _back(nearest: int = 0) -> WindowSpec:
    """Rows after the current one, read backwards; ``nearest=-1`` leaves it out."""
    return Window.partitionBy("page_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, nearest)


def drop_subtrees(nodes: DataFrame, root: Column) -> DataFrame:
    """Remove every node inside (or at) a node where ``root`` holds."""
    cover = F.coalesce(F.max(F.when(root, F.col("end"))).over(_upto()), F.lit(-1))
    return nodes.withColumn("_cover", cover).filter(F.col("_cover") < F.col("pos")).drop("_cover")


def without_noise(nodes: DataFrame) -> DataFrame:
    """Body rows without chrome."""
    noisy = (
        (F.col("tag") != TEXT)
        & (F.col("depth") > 0)
        & is_noise(F.col("tag"), F.col("depth"), F.col("attrs"))
    )
    return drop_subtrees(nodes.filter("in_body"), F.coalesce(noisy, F.lit(False)))


def with_clean_links(nodes: DataFrame, urls: DataFrame) -> DataFrame:
    """Add ``link``: the canonical href or src of a, img rows; ``urls`` is (page_id, url)."""
    raw = F.when(F.col("tag") == "a", F.col("attrs")["href"]).when(F.col("tag") == "img", F.col("attrs")["src"])
    joined = nodes.join(urls.select("page_id", F.col("url").alias("_base")), "page_id", "left")
    absolute = F.when(raw.isNotNull(), F.coalesce(absolutize(F.col("_base"), raw), raw))
    return joined.withColumn("link", canonical_url(absolute)).drop("_base")


def _escape(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    # Escapes of rendered HTML text and attribute values.
    for raw, entity in (
        ("&", "&amp;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("\r", "&#13;"),
    ):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def _start_tag(all_attrs: bool) -> Column:
    attrs, tag = F.col("attrs"), F.col("tag")
    closing = F.when(tag.isin(*VOID_TAGS), F.lit("/>")).otherwise(F.lit(">"))
    if all_attrs:
        written = F.transform(
            F.map_entries(attrs), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), _escape(e["value"]), F.lit('"'))
        )
        return F.concat(F.lit("<"), tag, F.coalesce(F.array_join(written, ""), F.lit("")), closing)

    def attr(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f' {name}="'), _escape(value), F.lit('"'))).otherwise("")

    kept = (
        F.when(tag == "a", attr("href", F.col("link")))
        .when(tag == "img", F.concat(attr("src", F.col("link")), attr("alt", attrs["alt"])))
        .when(tag == "time", attr("datetime", attrs["datetime"]))
        .otherwise("")
    )
    return F.concat(F.lit("<"), tag, kept, closing)


def rendered(
    nodes: DataFrame, group: str, all_attrs: bool = False, also: Sequence[Column] = ()
) -> DataFrame:
    """HTML and text of each group of nodes: (page_id, group, html, raw_text, ...).

    Only the compared attributes are written (links from ``link``), or with
    ``all_attrs`` every attribute as it was.  ``also`` are more aggregates of a
    group, found in the same pass.

    Opening tags sort at their position and closing tags at their end, inner
    ones first, so an ordered join of the pieces is the serialized subtree.
    """
    is_text = F.col("tag") == TEXT
    opening = F.struct(
        F.col("pos").alias("at"), F.lit(0).alias("k"), F.lit(0).alias("o"),
        F.when(is_text, F.coalesce(F.col("attrs")[WRITTEN], _escape(F.col("text")))).otherwise(_start_tag(all_attrs)).alias("s"),
    )
    closing = F.struct(
        F.col("end").alias("at"), F.lit(1).alias("k"), (-F.col("pos")).alias("o"),
        F.concat(F.lit("</"), F.col("tag"), F.lit(">")).alias("s"),
    )
    pieces = F.when(is_text | F.col("tag").isin(*VOID_TAGS), F.array(opening)).otherwise(F.array(opening, closing))
    ordered = F.array_sort(F.flatten(F.collect_list("_pieces")))
    texts = F.array_sort(F.collect_list(F.when(is_text, F.struct("pos", "text"))))
    return (
        nodes.withColumn("_pieces", pieces)
        .groupBy("page_id", group)
        .agg(
            F.array_join(F.transform(ordered, lambda p: p["s"]), "").alias("html"),
            F.array_join(F.transform(texts, lambda t: t["text"]), "").alias("raw_text"),
            *also,
        )
    )


def page_blocks(nodes: DataFrame, urls: DataFrame) -> DataFrame:
    """Leaf content blocks of every page in document order.

    A block is a block-level element with text, an image or a link and no
    block inside it; a page without any gives its whole body as one block.
    Columns: page_id, pos (0..), html, text, anchor, head, truncated; the last
    flags pages over MAX_BLOCKS, which are given whole all the same.
    """
    clean = with_clean_links(without_noise(nodes), urls)
    # Text counts when normalization leaves anything, which strips Unicode space too.
    has_text = (F.col("tag") == TEXT) & F.col("text").rlike("[^" + GO_SPACE[1:])
    content = has_text | F.col("tag").isin("a", "img")
    next_content = F.last(F.when(content, F.col("pos")), ignorenulls=True).over(_back())
    candidate = (F.col("tag").isin(*BLOCK_TAGS) | (F.col("depth") == 0)) & (F.col("_next") <= F.col("end"))
    inner = F.last(F.when(F.col("_cand"), F.col("pos")), ignorenulls=True).over(_back(-1))
    marked = (
        clean.withColumn("_next", next_content)
        .withColumn("_cand", F.coalesce(candidate, F.lit(False)))
        .withColumn("_inner", inner)
        .withColumn("_leaf", F.col("_cand") & ~F.coalesce(F.col("_inner") <= F.col("end"), F.lit(False)))
    )
    owner = F.last(
        F.when(F.col("_leaf"), F.struct(F.col("pos").alias("p"), F.col("end").alias("e"), F.col("tag").alias("t"))),
        ignorenulls=True,
    ).over(_upto())
    owned = (
        marked.withColumn("_o", owner)
        .filter(F.col("pos") <= F.col("_o.e"))
        .withColumn("block_pos", F.col("_o.p"))
    )
    own_anchor = F.coalesce(
        F.nullif(F.col("attrs")["id"], F.lit("")), F.nullif(F.col("attrs")["name"], F.lit(""))
    )
    # The first id or name in document order, and the block's own tag.  They come from the pass
    # that renders: joined to it, they would parse every page a second time.
    facts = [
        F.first("_o.t").alias("_tag"),
        F.min_by(own_anchor, F.when(own_anchor.isNotNull(), F.col("pos"))).alias("own_anchor"),
    ]
    html = rendered(owned, "block_pos", also=facts).withColumn("text", normalize_text(F.col("raw_text")))
    blocks = html.withColumn("is_heading", F.col("_tag").isin(*HEADING_TAGS))
    in_page = Window.partitionBy("page_id").orderBy("block_pos")
    numbered = blocks.withColumn("pos", F.row_number().over(in_page) - 1).withColumn(
        "truncated", F.count(F.lit(1)).over(Window.partitionBy("page_id")) > MAX_BLOCKS
    )
    return with_heading_context(numbered, ["page_id"]).select(
        "page_id", "pos", "html", "text", "is_heading", "anchor", "head", "truncated"
    )


def page_titles(nodes: DataFrame) -> DataFrame:
    """(page_id, page_title): text of the first non-empty <title>."""
    titles = nodes.filter((F.col("tag") == TEXT) & (F.col("parent_tag") == "title")).withColumn(
        "_t", normalize_text(F.col("text"))
    )
    return titles.groupBy("page_id").agg(
        F.min_by("_t", F.when(F.col("_t") != "", F.col("pos"))).alias("page_title")
    )


def inspect_elements(nodes: DataFrame) -> DataFrame:
    """Structural index of the display-safe elements of a page.

    Disallowed elements drop their whole subtree.  Ids count from 1 in
    document order and ``parent_id`` is the surviving parent (0 at the top).
    """
    body = nodes.filter(F.col("in_body") & (F.col("depth") > 0))
    unsafe = (F.col("tag") != TEXT) & ~F.col("tag").isin(*INSPECT_TAGS)
    kept = drop_subtrees(body, unsafe).filter(F.col("tag") != TEXT)
    # br, hr and img keep no children; style keeps only its text.
    in_page = Window.partitionBy("page_id").orderBy("pos")
    numbered = kept.withColumn("id", F.row_number().over(in_page))
    parents = numbered.select("page_id", F.col("pos").alias("parent"), F.col("id").alias("_pid"))
    return numbered.join(parents, ["page_id", "parent"], "left").select(
        "page_id",
        "id",
        "pos",
        F.coalesce("_pid", F.lit(0)).alias("parent_id"),
        "parent",
        "tag",
        F.filter(F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+"), lambda c: c != "").alias("classes"),
        F.col("attrs")["id"].alias("html_id"),
        strip_style_refs(F.col("attrs")["style"]).alias("style"),
        F.when(F.col("tag") == "img", F.col("attrs")["alt"]).alias("alt"),
    )


def strip_style_refs(css: Column) -> Column:
    """Remove external references from CSS text."""
    return F.regexp_replace(
        F.regexp_replace(css, r"(?i)@import\s+[^;]*;?", ""), r"(?i)url\(\s*[^)]*\)", ""
    )


def alternate_feeds(nodes: DataFrame, urls: DataFrame) -> DataFrame:
    """Feeds announced by pages: (page_id, pos, feed_url, title)."""
    attrs = F.col("attrs")
    links = nodes.filter(
        (F.col("tag") == "link")
        & F.contains(F.coalesce(attrs["rel"], F.lit("")), F.lit("alternate"))
        & F.lower(F.trim(attrs["type"])).isin(*FEED_TYPES)
        & (F.coalesce(attrs["href"], F.lit("")) != "")
    )
    joined = links.join(urls.select("page_id", "url"), "page_id")
    return joined.select(
        "page_id",
        "pos",
        F.coalesce(absolutize(F.col("url"), attrs["href"]), attrs["href"]).alias("feed_url"),
        F.coalesce(attrs["title"], F.lit("")).alias("title"),
    )


def _scan(value: Any) -> str:
    """First datePublished of an article-like object anywhere in JSON-LD, in document order."""
    waiting = [value]
    while waiting:
        one = waiting.pop()
        if isinstance(one, dict):
            kind = one.get("@type")
            if isinstance(kind, list):
                kind = next((k for k in kind if isinstance(k, str)), "")
            date = one.get("datePublished")
            if isinstance(kind, str) and kind in ARTICLE_TYPES and isinstance(date, str) and date:
                return date
            waiting += reversed(list(one.values()))
        elif isinstance(one, list):
            waiting += reversed(one)
    return ""


@F.pandas_udf(T.StringType())
def jsonld_date(raw: pd.Series) -> pd.Series:
    """Null for a text that is no JSON or is nested beyond what the parser takes."""

    def one(text: str | None) -> str | None:
        try:
            return _scan(json.loads(text or "null")) or None
        except (ValueError, RecursionError):
            return None

    return raw.map(one)


def published_dates(nodes: DataFrame, now: int) -> DataFrame:
    """(page_id, published_at) from meta, then JSON-LD, then the first <time>.

    A source whose first value is unusable falls through to the next one.  The
    few rows that may hold a date are kept first, so pages are parsed once.
    """
    attrs = F.col("attrs")
    # A later attribute of the two overrides an earlier one; a map keeps no
    # order, so property is read before name.
    prop = F.coalesce(attrs["property"], attrs["name"])
    in_ld = (F.col("tag") == TEXT) & (F.col("parent_tag") == "script")
    dated = nodes.filter(F.col("tag").isin("meta", "script", "time") | in_ld)
    nodes = cut_lineage(dated.select("page_id", "pos", "parent", "parent_tag", "tag", "attrs", "text"))
    scripts = nodes.filter(F.col("tag") == "script").filter(
        F.lower(attrs["type"]) == "application/ld+json"
    ).select("page_id", F.col("pos").alias("parent"))
    ld = (
        nodes.filter(in_ld)
        .join(scripts, ["page_id", "parent"])
        .withColumn("v", jsonld_date(F.col("text")))
        .select("page_id", "pos", F.lit(1).alias("rank"), "v")
    )
    meta = nodes.filter((F.col("tag") == "meta") & (prop == "article:published_time")).select(
        "page_id", "pos", F.lit(0).alias("rank"), F.nullif(attrs["content"], F.lit("")).alias("v")
    )
    times = nodes.filter(F.col("tag") == "time").select(
        "page_id", "pos", F.lit(2).alias("rank"), F.nullif(attrs["datetime"], F.lit("")).alias("v")
    )
    firsts = (
        meta.unionByName(ld).unionByName(times).filter(F.col("v").isNotNull())
        .groupBy("page_id", "rank").agg(F.min_by("v", "pos").alias("v"))
        .withColumn("t", flexible_date(F.col("v"), F.lit(now)))
    )
    return firsts.groupBy("page_id").agg(
        F.min_by("t", F.when(F.col("t").isNotNull(), F.col("rank"))).alias("published_at")
    ).filter(F.col("published_at").isNotNull())


# Elements whose text counts as prose when an article is scored.
PROSE_TAGS = ("p", "pre", "blockquote", "td", "li", "h2", "h3")
MIN_PROSE_CHARS = 25


def article_bodies(nodes: DataFrame, urls: DataFrame) -> DataFrame:
    """The densest text container of each page: (page_id, content, text_len).

    Prose elements give their text length, less their links, to the parent and
    half of it to the grandparent; the best container wins, outermost first on
    ties.  This is a heuristic of its own, not a byte-for-byte readability.
    """
    clean = with_clean_links(
        drop_subtrees(
            nodes.filter("in_body"),
            F.coalesce(
                (F.col("tag") != TEXT) & (F.col("depth") > 0)
                & F.col("tag").isin("script", "style", "noscript", "template", "svg", "iframe", "form", "nav",
                                    "header", "footer", "aside"),
                F.lit(False),
            ),
        ),
        urls,
    )
    length = F.when(F.col("tag") == TEXT, F.char_length(F.trim(F.regexp_replace("text", r"\s+", " ")))).otherwise(0)
    in_link = F.coalesce(F.max(F.when(F.col("tag") == "a", F.col("end"))).over(_upto()), F.lit(-1)) >= F.col("pos")
    prose = F.when(F.col("tag").isin(*PROSE_TAGS), F.struct(F.col("pos").alias("p"), F.col("end").alias("e"), F.col("parent").alias("up")))
    owner = F.last(prose, ignorenulls=True).over(_upto())
    scored = (
        clean.withColumn("_len", F.when(in_link, 0).otherwise(length))
        .withColumn("_o", owner)
        .filter((F.col("pos") <= F.col("_o.e")) & (F.col("_len") > 0))
        .groupBy("page_id", F.col("_o.p").alias("_p"), F.col("_o.up").alias("container"))
        .agg(F.sum("_len").alias("_len"))
        .filter(F.col("_len") >= MIN_PROSE_CHARS)
    )
    up = clean.select("page_id", F.col("pos").alias("container"), F.col("parent").alias("_grand"))
    shares = scored.join(up, ["page_id", "container"]).select(
        "page_id",
        F.explode(
            F.array(
                F.struct(F.col("container").alias("c"), F.col("_len").cast("double").alias("s")),
                F.struct(F.col("_grand").alias("c"), (F.col("_len") / 2).alias("s")),
            )
        ).alias("_x"),
    ).groupBy("page_id", F.col("_x.c").alias("pos")).agg(F.sum("_x.s").alias("score"))
    best = shares.join(clean.select("page_id", "pos", "end"), ["page_id", "pos"]).groupBy("page_id").agg(
        F.max_by(F.struct("pos", "end"), F.struct("score", -F.col("pos"))).alias("_b")
    )
    inside = clean.join(best.select("page_id", F.col("_b.pos").alias("_from"), F.col("_b.end").alias("_to")), "page_id")
    article = inside.filter(F.col("pos").between(F.col("_from"), F.col("_to")))
    return rendered(article, "_from").select(
        "page_id",
        F.col("html").alias("content"),
        F.char_length(normalize_text(F.col("raw_text"))).alias("text_len"),
    )


def article_links(nodes: DataFrame, urls: DataFrame) -> DataFrame:
    """http(s) links of each page, resolved: (page_id, pos, url, text)."""
    anchors = nodes.filter(F.col("in_body") & (F.col("tag") == "a") & (F.coalesce(F.col("attrs")["href"], F.lit("")) != ""))
    joined = anchors.join(urls.select("page_id", F.col("url").alias("_base")), "page_id")
    return joined.select(
        "page_id", "pos", "end", resolve_url(F.col("_base"), F.col("attrs")["href"]).alias("url")
    ).filter("url <> ''")


def anonymized_pages(nodes: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Pages with every text run masked by character class, markup kept.

    Comments are gone; ``keep`` lists patterns whose text runs stay as they are.
    """
    plain = F.when(F.col("tag") != TEXT, F.col("attrs"))
    masked = nodes.withColumns(
        {"text": anonymize_text(F.col("text"), keep), "attrs": plain, "_page": F.col("page_id")}
    )
    return rendered(masked, "_page", all_attrs=True).select(
        "page_id", F.concat(F.lit("<!DOCTYPE html><html>"), "html", F.lit("</html>")).alias("html")
    )


def unmasked_text(nodes: DataFrame) -> DataFrame:
    """(page_id, n) text runs that still hold unmasked letters or digits."""
    runs = nodes.filter((F.col("tag") == TEXT) & ~is_anonymized(F.col("text")))
    return runs.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
