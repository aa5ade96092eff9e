"""Feed documents to item rows, and item rows to an ingest batch."""

from __future__ import annotations

import datetime
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.entities import html5
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.dates import published_or_now
from skein.functions.items import blank, entry_guid, raw_body
from skein.functions.text import trim_space, truncate_utf8
from skein.functions.urls import resolve_url
from skein.session import spread
from skein.sources.charset import sniff_xml
from skein.sources.sanitize import sanitize_html

MAX_ITEMS = 1000

ITEM_SCHEMA = (
    "feed_id bigint, feed_url string, pos int, feed_title string, feed_link string, guid string, link string, "
    "title string, author string, content string, description string, published bigint, updated bigint, error string"
)
_COLUMNS = [c.split()[0] for c in ITEM_SCHEMA.split(", ")]
_FIELDS = _COLUMNS[5:13]
# Namespaces of the extensions that carry item fields.
_DC = "{http://purl.org/dc/elements/1.1/}"
_CONTENT = "{http://purl.org/rss/1.0/modules/content/}encoded"
_NAMED_ENTITY = re.compile(r"&([A-Za-z][A-Za-z0-9]*);")
_BARE_AMPERSAND = re.compile(r"&(?!#[0-9]+;|#x[0-9A-Fa-f]+;|[A-Za-z][A-Za-z0-9]*;)")
_RFC822_NAME = re.compile(r"\(([^)]+)\)\s*$")


def _epoch(text: str | None) -> int | None:
    if not text or not text.strip():
        return None
    s = text.strip()
    for read in (datetime.datetime.fromisoformat, parsedate_to_datetime):
        try:
            at = read(s)
        except (ValueError, TypeError, IndexError):
            continue
        return int((at if at.tzinfo else at.replace(tzinfo=datetime.UTC)).timestamp())
    return None


def _local(node: ET.Element) -> str:
    return node.tag.rsplit("}", 1)[-1] if isinstance(node.tag, str) else ""


def _text(parent: ET.Element, *names: str) -> str:
    """Text of the first child with one of the names, in order of the names.

    A name with a namespace must match exactly; a bare one matches elements of
    the feed's own vocabulary only.
    """
    for name in names:
        for child in parent:
            extension = child.tag.startswith(_DC) or child.tag == _CONTENT
            if child.tag == name or (not extension and _local(child) == name):
                return "".join(child.itertext()) if len(child) == 0 else _markup(child)
    return ""


def _markup(node: ET.Element) -> str:
    """Inline XHTML content of an element, without namespace prefixes."""
    for e in node.iter():
        e.tag = _local(e)
    inner = (node.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in node)
    return inner.strip()


def _atom_link(parent: ET.Element) -> str:
    links = [c for c in parent if _local(c) == "link"]
    for link in links:
        if link.get("rel", "alternate") == "alternate" and link.get("href"):
            return link.get("href", "")
    return ""


def _rss_item(item: ET.Element) -> tuple:
    author = _text(item, "author", f"{_DC}creator")
    name = _RFC822_NAME.search(author)
    published = _epoch(_text(item, "pubDate") or _text(item, f"{_DC}date"))
    return (
        _text(item, "guid").strip(), _text(item, "link").strip() or _atom_link(item), _text(item, "title"),
        (name.group(1) if name else author).strip(), _text(item, _CONTENT), _text(item, "description"),
        published, _epoch(_text(item, f"{_DC}date")),
    )


def _atom_entry(entry: ET.Element) -> tuple:
    authors = [c for c in entry if _local(c) == "author"]
    published, updated = _epoch(_text(entry, "published")), _epoch(_text(entry, "updated"))
    return (
        _text(entry, "id").strip(), _atom_link(entry), _text(entry, "title"),
        _text(authors[0], "name").strip() if authors else "", _text(entry, "content"), _text(entry, "summary"),
        published if published is not None else updated, updated,
    )


def _json_item(item: dict) -> tuple:
    author = item.get("author") or next(iter(item.get("authors") or []), {})
    return (
        str(item.get("id") or ""), item.get("url") or "", item.get("title") or "", author.get("name") or "",
        item.get("content_html") or item.get("content_text") or "", item.get("summary") or "",
        _epoch(item.get("date_published")), _epoch(item.get("date_modified")),
    )


def _xml_root(document: str) -> ET.Element:
    """The root element; a document that fails is read again with HTML entities and bare ampersands mended."""
    try:
        return ET.fromstring(document)
    except ET.ParseError:
        return ET.fromstring(_BARE_AMPERSAND.sub("&amp;", _NAMED_ENTITY.sub(_numeric, document)))


def _numeric(entity: re.Match[str]) -> str:
    spelled = html5.get(f"{entity[1]};")
    if entity[1] in ("amp", "lt", "gt", "quot", "apos") or spelled is None:
        return entity[0]
    return "".join(f"&#{ord(c)};" for c in spelled)


def _as_text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else str(value)


def _read_feed(body: bytes) -> tuple[str, str, list[tuple]]:
    """(title, link, items) of an RSS, Atom or JSON feed, items in feed order."""
    if body.lstrip()[:1] == b"{":
        doc = json.loads(body)
        items = [_json_item(i) for i in doc.get("items") or [] if isinstance(i, dict)]
        return doc.get("title") or "", doc.get("home_page_url") or "", items
    root = _xml_root(sniff_xml(body))
    kind = _local(root)
    if kind == "feed":
        entries = [c for c in root if _local(c) == "entry"]
        return _text(root, "title"), _atom_link(root), [_atom_entry(e) for e in entries]
    if kind in ("rss", "RDF"):
        channel = next((c for c in root if _local(c) == "channel"), root)
        found = [c for c in (*channel, *root) if _local(c) == "item"]
        return _text(channel, "title"), _text(channel, "link").strip(), [_rss_item(i) for i in found]
    raise ValueError(f"not a feed: <{kind}>")


def feed_items(fetched: DataFrame) -> DataFrame:
    """Item rows of (feed_id, feed_url, body) responses, at most 1000 per feed.

    A response that is no feed gives one row with ``error`` set and no item.
    """

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for feed, url, body in zip(batch["feed_id"], batch["feed_url"], batch["body"], strict=True):
                try:
                    title, link, found = _read_feed(bytes(body or b""))
                except Exception as err:  # one hostile response is one error row
                    out.append((feed, url, None, None, None, *[None] * len(_FIELDS), str(err) or type(err).__name__))
                    continue
                title, link = _as_text(title), _as_text(link)
                out += [
                    (feed, url, i, title, link, *map(_as_text, item[:-2]), *item[-2:], None)
                    for i, item in enumerate(found[:MAX_ITEMS])
                ]
                if not found:
                    out.append((feed, url, None, title, link, *[None] * len(_FIELDS), None))
            frame = pd.DataFrame(out, columns=_COLUMNS)
            yield frame.astype({"pos": "Int32", "published": "Int64", "updated": "Int64"})

    return spread(fetched.select("feed_id", "feed_url", "body"), "feed_id").mapInPandas(explode, ITEM_SCHEMA)


def feed_headers(items: DataFrame) -> DataFrame:
    """(feed_id, title, site_url, error): one row per parsed response."""
    first = items.filter(F.col("pos").isNull() | (F.col("pos") == 0))
    return first.select(
        "feed_id",
        trim_space(blank(F.col("feed_title"))).alias("title"),
        resolve_url(F.col("feed_url"), blank(F.col("feed_link"))).alias("site_url"),
        "error",
    )


def normalize_items(items: DataFrame, now: int | Column) -> DataFrame:
    """The ingest batch of parsed items: links resolved, bodies sanitized, dates filled.

    ``now`` is the round's time, or a column of each item's own.
    """
    clock = (now if isinstance(now, Column) else F.lit(now)).cast("bigint")
    body = raw_body(F.col("content"), F.col("description"))
    parsed = items.filter(F.col("pos").isNotNull()).withColumns(
        {"_link": resolve_url(F.col("feed_url"), blank(F.col("link"))), "_raw": body}
    )
    clean = truncate_utf8(sanitize_html(F.col("_raw")))
    published = published_or_now(F.col("published"), clock)
    return parsed.select(
        "feed_id",
        F.col("pos").cast("bigint").alias("pos"),
        entry_guid(F.col("guid"), F.col("_link"), F.col("title"), F.col("_raw")).alias("guid"),
        F.col("_link").alias("url"),
        trim_space(blank(F.col("title"))).alias("title"),
        blank(F.col("author")).alias("author"),
        clean.alias("body"),
        published.alias("published_at"),
        F.coalesce(F.col("updated"), published).alias("updated_at"),
        F.col("published").isNull().alias("date_missing"),
    )
