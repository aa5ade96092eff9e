"""Plain restatements of the result contracts, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

TESTDATA = "/root/testdata"


def digest(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def secrets(text):
    text = text or ""
    found = [
        (m.start(), 0, "assign", m.end())
        for m in re.finditer(
            r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
            r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
            text,
        )
        if len(m[2]) >= 6
    ]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    found.sort()
    return [(k, s, e) for s, _, k, e in found]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal(text):
    text = text or ""
    found = [
        (m.start(), 0, "email", m.end())
        for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)
    ]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, "phone", m.end()))
    found.sort()
    return [(k, s, e) for s, _, k, e in found]


def quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + j for i, w in enumerate(windows) if w in often for j in range(3)}
    n = len(words)
    return {
        "n_words": n,
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "base_failed": n < 50 or 100 * len(covered) > 50 * n,
    }


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def contamination(text, items):
    words = words_of(text)
    hit, found = set(), set()
    for item, item_text in items:
        w = words_of(item_text)
        if not w:
            continue
        k = min(10, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in windows:
                hit.update(range(i, i + k))
                found.add(str(item))
    return {
        "n_words": len(words),
        "n_hit": len(hit),
        "n_items": len(found),
        "items_sha256": sha(",".join(sorted(found))),
        "contaminated": bool(hit),
    }


def repeats(rows, size=50):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    first = {}
    for doc, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - size + 1):
            gram = raw[i : i + size]
            first[gram] = min(first.get(gram, doc), doc)
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - size + 1):
            if first[raw[i : i + size]] < doc:
                gone[i : i + size] = b"\x01" * size
        spans = len(re.findall(b"\x01+", bytes(gone)))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def shard_facts(text):
    raw = (text or "").encode()
    return len(raw) + 16, zlib.crc32(raw)
