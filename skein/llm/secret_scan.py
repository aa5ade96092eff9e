"""Secret scan: keyword automaton, anchored patterns at its hits, embedded checksums.

One Aho-Corasick pass over the lower-cased bytes of a text names the places
where a keyword stands.  Only there are the patterns tried, anchored at the
keyword.  Token formats that carry a checksum or a structure are kept only if
it holds.  Long hexadecimal runs have no keyword; they are found by their own
pattern over the text.

Null and empty texts give no spans, and an empty table an empty one.  Repeated rows give repeated results; the
text is scanned whole, in time linear in its length.  Only the id and text
columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import binascii
import functools
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import map_batches

# Kinds in their order, keywords of the automaton, token formats.
BASE_KINDS = ("assign", "access", "hex")
ADDED_KINDS = ("github", "npm", "jwt", "pem")
KEYWORDS = {
    "password": "assign",
    "passwd": "assign",
    "secret": "assign",
    "token": "assign",
    "api_key": "assign",
    "apikey": "assign",
    "akia": "access",
    "ghp_": "github",
    "gho_": "github",
    "ghu_": "github",
    "ghs_": "github",
    "ghr_": "github",
    "npm_": "npm",
    "eyj": "jwt",
    "-----begin": "pem",
}
ASSIGN = re.compile(
    rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"(?<![0-9a-f])[0-9a-f]{24,}")
CHECKED = {
    "github": re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
    "npm": re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
    "jwt": re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+"),
    "pem": re.compile(rb"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----"),
}
#: What a token's part may hold: where a match failed, it fails from every later start in the same run.
PART = re.compile(rb"[A-Za-z0-9_-]*+")
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


@functools.cache
def automaton():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        machine.add_word(word, (len(word), kind))
    machine.make_automaton()
    return machine


def base62_crc(body: bytes) -> bytes:
    """The six base-62 digits of the body's CRC-32."""
    value, digits = zlib.crc32(body), bytearray()
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits.append(BASE62[digit])
    return bytes(reversed(digits))


def _is_json(part: bytes, field: str | None) -> bool:
    try:
        found = json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(found, dict) and (field is None or field in found)


def valid(kind: str, match: re.Match[bytes]) -> bool:
    """Whether the checksum or structure that the format embeds holds."""
    if kind in ("github", "npm"):
        return base62_crc(match[1]) == match[2]
    if kind == "jwt":
        return _is_json(match[1], "alg") and _is_json(match[2], None)
    return True


def scan(raw: bytes) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of one UTF-8 text, in code points, by start then kind."""
    hits: dict[str, list[int]] = {}
    for end, (size, kind) in automaton().iter(raw.lower().decode("latin-1")):
        hits.setdefault(kind, []).append(end - size + 1)
    found: list[tuple[str, int, int, bool]] = []
    for kind, starts in hits.items():
        pattern = ASSIGN if kind == "assign" else ACCESS if kind == "access" else CHECKED[kind]
        done = 0
        for start in sorted(set(starts)):
            if start < done:
                continue
            if not (match := pattern.match(raw, start)):
                if kind == "jwt" and raw.startswith(b"eyJ", start):
                    done = PART.match(raw, start).end()
                continue
            done = match.end()
            if kind == "assign":
                keep = len(match[1]) >= 6
            elif kind == "access":
                keep = done - start >= 20
            else:
                keep = valid(kind, match)
                if kind == "jwt" and not keep:
                    done = match.end(1)  # its second part may begin a token
            if keep:
                found.append((kind, start, done, kind in BASE_KINDS))
    found += [("hex", m.start(), m.end(), True) for m in HEX.finditer(raw)]
    order = {k: i for i, k in enumerate((*BASE_KINDS, *ADDED_KINDS))}
    found.sort(key=lambda s: (s[1], order[s[0]]))
    return _in_code_points(raw, found)


def _in_code_points(raw: bytes, found: list[tuple[str, int, int, bool]]) -> list[tuple[str, int, int, bool]]:
    if not found or raw.isascii():
        return found
    out, at, points = [], 0, 0
    for kind, start, end, base in found:
        points += len(raw[at:start].decode("utf-8", "replace"))
        at = start
        out.append((kind, points, points + end - start, base))  # every span is ASCII
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id`` and ``spans`` (kind, start, end, base)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(
            pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
        )
        for batch in batches:
            spans = [
                [dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in scan(raw or b"")]
                for raw in batch.column("raw").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.encode(text_col, "UTF-8").alias("raw"))
    id_type = dict(narrow.dtypes)["doc_id"]
    return map_batches(narrow, run, f"doc_id {id_type}, spans {SPANS}")
