"""Allow-list sanitizing of entry bodies."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.sources.dom import VOID_TAGS

# Elements a body may keep.
ALLOWED_TAGS = frozenset(
    "article aside figure section summary details hgroup h1 h2 h3 h4 h5 h6 br div hr p span wbr a abbr "
    "acronym cite code dfn em figcaption mark s samp strong sub sup var q time b i pre small strike tt u "
    "rp rt ruby map area img ins del ol ul li dl dt dd table caption col colgroup tbody td tfoot th thead "
    "tr meter progress blockquote".split()
)
# Elements dropped together with their text.
DROPPED_WITH_TEXT = frozenset("script style noscript iframe object embed noembed noframes nolayer".split())
# Attributes kept per element; "*" applies to all.
ALLOWED_ATTRS = {
    "*": {"dir", "lang", "id", "title"},
    "a": {"href"}, "area": {"href", "alt", "coords", "rel", "shape"}, "q": {"cite"}, "blockquote": {"cite"},
    "time": {"datetime"}, "ins": {"cite", "datetime"}, "del": {"cite", "datetime"},
    "img": {"src", "align", "alt", "height", "width"}, "ol": {"type"}, "ul": {"type"}, "li": {"type", "value"},
    "table": {"height", "width", "summary"}, "td": {"abbr", "align", "colspan", "rowspan", "headers", "height",
    "width", "scope", "valign", "nowrap"}, "th": {"abbr", "align", "colspan", "rowspan", "headers", "height",
    "width", "scope", "valign", "nowrap"}, "tr": {"align", "valign"}, "tbody": {"align", "valign"},
    "thead": {"align", "valign"}, "tfoot": {"align", "valign"}, "col": {"align", "span", "width", "valign"},
    "colgroup": {"align", "span", "width", "valign"}, "details": {"open"}, "map": {"name"},
    "meter": {"value", "min", "max", "low", "high", "optimum"}, "progress": {"value", "max"},
}
URL_ATTRS = frozenset({"href", "src", "cite"})
# The one embed marker that survives, with its exact shape.
EMBED_ATTR = "data-instgrm-permalink"
EMBED_CLASS = "instagram-media"
EMBED_URL = re.compile(r"https://(?:www\.)?instagram\.com/(?:p|reel)/[A-Za-z0-9_-]+/(?:\?[^\"'<>\s]*)?")
_SCHEME = re.compile(r"\s*([A-Za-z][A-Za-z0-9+.-]*):")


def _url_ok(value: str) -> bool:
    scheme = _SCHEME.match(value)
    return scheme is None or scheme.group(1).lower() in ("http", "https", "mailto")


def _attr_ok(tag: str, name: str, value: str) -> bool:
    if tag == "blockquote" and name == "class":
        return value == EMBED_CLASS
    if tag == "blockquote" and name == EMBED_ATTR:
        return EMBED_URL.fullmatch(value) is not None
    if name in ALLOWED_ATTRS["*"] or name in ALLOWED_ATTRS.get(tag, ()):
        return name not in URL_ATTRS or _url_ok(value)
    return False


class _Sanitizer(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.dropping: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in DROPPED_WITH_TEXT:
            self.dropping.append(tag)
        if self.dropping or tag not in ALLOWED_TAGS:
            return
        kept = [(k, v or "") for k, v in attrs if _attr_ok(tag, k, v or "")]
        if tag == "a" and not kept:
            return
        if tag == "a" and any(k == "href" for k, _ in kept):
            kept.append(("rel", "nofollow"))
        if tag == "img" and not any(k == "src" for k, _ in kept):
            return
        written = "".join(f' {k}="{html.escape(v)}"' for k, v in kept)
        self.out.append(f"<{tag}{written}{'/' if tag in VOID_TAGS else ''}>")

    def handle_endtag(self, tag: str) -> None:
        if self.dropping:
            if tag == self.dropping[-1]:
                self.dropping.pop()
        elif tag in ALLOWED_TAGS and tag not in VOID_TAGS:
            self.out.append(f"</{tag}>")

    def handle_data(self, data: str) -> None:
        if not self.dropping:
            self.out.append(html.escape(data))


def sanitize(body: str) -> str:
    if "<" not in body and "&" not in body:
        return html.escape(body)
    parser = _Sanitizer()
    parser.feed(body)
    parser.close()
    return "".join(parser.out)


@F.pandas_udf(T.StringType())
def sanitize_html(body: pd.Series) -> pd.Series:
    """A body reduced to allowed markup; scripts vanish with their text."""
    return body.map(lambda b: None if b is None else sanitize(b))
