"""Decoding raw bytes to text."""

from __future__ import annotations

import codecs
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_META = re.compile(rb"""<meta[^>]+charset\s*=\s*["']?\s*([A-Za-z0-9_:.-]+)""", re.IGNORECASE)
_HEADER = re.compile(r"""charset\s*=\s*["']?\s*([A-Za-z0-9_:.-]+)""", re.IGNORECASE)
_XML = re.compile(rb"""^\s*<\?xml[^>]*encoding\s*=\s*["']([A-Za-z0-9_:.-]+)["']""")
SNIFF_BYTES = 1024

# Labels the web maps to a superset encoding.
_WEB_LABELS = {
    "shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932", "x-sjis": "cp932",
    "windows-31j": "cp932", "iso-8859-1": "cp1252", "latin1": "cp1252", "ascii": "cp1252",
    "us-ascii": "cp1252", "gb2312": "gbk", "ks_c_5601-1987": "cp949", "euc-kr": "cp949",
}
# Byte order marks, longest match not needed.
_BOMS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_BE, "utf-16-be"), (codecs.BOM_UTF16_LE, "utf-16-le"))


def _codec(label: str | bytes | None) -> str | None:
    if not label:
        return None
    name = (label.decode("ascii", "ignore") if isinstance(label, bytes) else label).lower()
    try:
        return codecs.lookup(_WEB_LABELS.get(name, name)).name
    except LookupError:
        return None


def decode(body: bytes, content_type: str | None) -> str:
    """BOM, header charset, ``<meta>``, then UTF-8 if valid, else windows-1252."""
    for bom, name in _BOMS:
        if body.startswith(bom):
            return body[len(bom) :].decode(name, "replace")
    header = _HEADER.search(content_type or "")
    meta = _META.search(body[:SNIFF_BYTES])
    name = _codec(header.group(1) if header else None) or _codec(meta.group(1) if meta else None)
    if name:
        return body.decode(name, "replace")
    try:
        return body.decode("utf-8")
    except UnicodeDecodeError:
        return body.decode("cp1252", "replace")


@F.pandas_udf(T.StringType())
def decode_html(body: pd.Series, content_type: pd.Series) -> pd.Series:
    """Text of an HTML response; Spark's own decoder lacks the Japanese charsets."""
    return pd.Series(
        [None if b is None else decode(bytes(b), c) for b, c in zip(body, content_type, strict=True)],
        dtype="object",
    )


def sniff_xml(content: bytes) -> str:
    """XML text with its declared encoding resolved and the declaration removed."""
    for bom, name in _BOMS:
        if content.startswith(bom):
            text = content[len(bom) :].decode(name, "replace")
            break
    else:
        declared = _XML.search(content[:SNIFF_BYTES])
        name = _codec(declared.group(1)) if declared else "utf-8"
        if name is None:
            raise LookupError(f"unknown encoding {declared.group(1)!r}")
        text = content.decode(name, "strict" if name != "utf-8" else "replace")
    return re.sub(r"^\s*<\?xml[^>]*\?>", "", text, count=1)
