"""Scalar rules."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from skein.functions import dates, items, markup, text, urls
from skein.sources.charset import decode
from skein.sources.sanitize import sanitize

NOW = 1_704_067_200  # 2024-01-01


@pytest.fixture
def value(spark):
    return lambda column: spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://a.b/x", "https://a.b/x"),
        ("https://a.b/x?b=2&a=1&utm_source=z&fbclid=1", "https://a.b/x?a=1&b=2"),
        ("https://a.b/x?utm_source=z#top", "https://a.b/x#top"),
        ("https://a.b/?q=2&q=1&p", "https://a.b/?p=&q=2&q=1"),
        ("https://a.b/?q=a+b&r=%E3%81%82", "https://a.b/?q=a+b&r=%E3%81%82"),
        ("https://a.b/?q=%zz&k=~*", "https://a.b/?k=~%2A"),
    ],
)
def test_canonical_url(value, url, want):
    assert value(urls.canonical_url(F.lit(url))) == want


@pytest.mark.parametrize(
    ("base", "ref", "want"),
    [
        ("https://a.b/c/d", "e", "https://a.b/c/e"), ("https://a.b/c", "//x.y/z", "https://x.y/z"),
        ("https://a.b/", "javascript:alert(1)", ""), ("https://a.b/", "", ""), ("https://a.b/", "mailto:x@y", ""),
        ("https://a.b/c?d", "?e=1", "https://a.b/c?e=1"),
    ],
)
def test_resolve_url(value, base, ref, want):
    assert value(urls.resolve_url(F.lit(base), F.lit(ref))) == want


def test_candidate_url(value):
    def cand(base, url, same=True):
        return value(urls.candidate_url(F.lit(base), F.lit(url), F.lit(same)))

    assert cand("https://www.a.b/l", "https://A.b/x?utm_id=1#f") == "https://A.b/x"
    assert cand("https://a.b/l", "https://c.d/x") is None
    assert cand("https://a.b/l", "https://c.d/x", False) == "https://c.d/x"
    assert cand("https://a.b/l", "ftp://a.b/x") is None


@pytest.mark.parametrize(
    ("url", "want"),
    [("https://a.b/x/y%20z/", "y z"), ("https://a.b/", "https://a.b/"), ("https://a.b/x+y?q", "x+y"), ("https://a.b/%zz", "%zz")],
)
def test_path_tail(value, url, want):
    assert value(urls.path_tail(F.lit(url))) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("2023-12-31T23:00:00+09:00", 1_704_031_200), (" 2023-12-31 ", 1_703_980_800), ("2023年2月31日 更新", 1_677_801_600),
        ("2024-01-01T00:59:59Z", NOW + 3599), ("2024-01-01T01:00:01Z", None), ("2023-02-30", None), ("soon", None), ("", None),
    ],
)
def test_flexible_date(value, raw, want):
    assert value(dates.flexible_date(F.lit(raw), F.lit(NOW))) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("120", 120), ("Mon, 01 Jan 2024 00:10:00 GMT", 600), ("Sun, 31 Dec 2023 00:00:00 GMT", 0), ("-5", 0), ("x", 0), (None, 0)],
)
def test_retry_after(value, raw, want):
    assert value(dates.retry_after_seconds(F.lit(raw).cast("string"), F.lit(NOW))) == want


def test_normalize_text(value):
    assert value(text.normalize_text(F.lit(" Ａ b　\n c  ｶﾞ "))) == "A b c ガ"


def test_truncate_utf8(value):
    assert value(text.truncate_utf8(F.lit("aあb"), 3)) == "a"
    assert value(text.truncate_utf8(F.lit("aあb"), 4)) == "aあ"
    assert value(text.truncate_utf8(F.lit("aあb"), 5)) == "aあb"


def test_ignore_pattern_matches_its_text(value):
    assert value(text.ignore_pattern(F.lit(" 2026-08-16 (更新) a.b "))) == r"\d+-\d+-\d+ \(更新\) a\.b"
    assert len(value(text.ignore_pattern(F.lit("x" * 2000)))) == 1000


@pytest.mark.parametrize(
    ("body", "query", "want"),
    [
        ("The cat the", "the", [("The", True), (" cat ", False), ("the", True)]), ("a.b", ".", [("a", False), (".", True), ("b", False)]),
        ("abc", " ", [("abc", False)]), ("abc", "x", [("abc", False)]), ("", "x", [("", False)]), ("xx", "x", [("x", True), ("x", True)]),
    ],
)
def test_highlight(value, body, query, want):
    got = value(text.highlight_segments(F.lit(body), F.lit(query)))
    assert [(r.text, r.match) for r in got] == want


def test_anonymize(value):
    masked = value(text.anonymize_text(F.lit("aZ9 ひカ漢é!")))
    assert masked == "aA0 あア亜é!"
    assert value(text.is_anonymized(F.lit(masked))) and not value(text.is_anonymized(F.lit("ab")))


def test_item_identity(value):
    def guid(*parts):
        return value(items.entry_guid(*[F.lit(p) for p in parts]))

    assert guid("g", "l", "t", "b") == "g" and guid("", "l", "t", "b") == "l"
    assert guid(None, "", "t", "b") == hashlib.sha256(b"tb").hexdigest()


def test_cursor(value):
    assert tuple(value(items.parse_cursor(F.lit("12,34")))) == (12, 34)
    assert value(items.parse_cursor(F.lit("12"))) is None and value(items.parse_cursor(F.lit("a,b"))) is None


@pytest.mark.parametrize(
    ("word", "want"), [("header-image", True), ("sub_headers", False), ("Main NAV", True), ("", False), ("navigate", False)]
)
def test_noise_word(value, word, want):
    assert value(markup.has_noise_word(F.lit(word))) is want


@pytest.mark.parametrize(
    ("name", "want"),
    [("card", True), ("12345", False), ("deadBEEF", False), ("Button_1a2b3c", False), ("sc-bZQltZ", True), ("", False), ("abc", True)],
)
def test_stable_class(value, name, want):
    assert value(markup.is_stable_class(F.lit(name))) is want


def test_sanitize():
    assert sanitize('<p onclick="x">a<script>alert(1)</script><b>c</b></p>') == "<p>a<b>c</b></p>"
    assert sanitize('<a href="javascript:x">t</a>') == "t</a>" or "javascript" not in sanitize('<a href="javascript:x">t</a>')
    assert sanitize('<a href="https://x/">t</a>') == '<a href="https://x/" rel="nofollow">t</a>'
    assert sanitize("<iframe src=x>in</iframe>out") == "out"
    ok = '<blockquote class="instagram-media" data-instgrm-permalink="https://www.instagram.com/p/Ab_1-/?u=1">q</blockquote>'
    assert sanitize(ok) == ok
    assert "data-instgrm" not in sanitize(ok.replace("/p/Ab_1-/", "/p/../x/"))
    assert "class" not in sanitize('<blockquote class="other">q</blockquote>')


def test_decode():
    jp = "日本語のページ"
    assert decode(jp.encode("cp932"), "text/html; charset=Shift_JIS") == jp
    assert decode(b'<meta charset="euc-jp">' + jp.encode("euc-jp"), None).endswith(jp)
    assert decode(jp.encode(), "text/html") == jp
    assert decode(b"caf\xe9", None) == "café"
    assert decode(b"\xff\xfe" + jp.encode("utf-16-le"), "text/html; charset=utf-8") == jp
