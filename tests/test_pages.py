"""HTML to rows to blocks, articles and candidates."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skein.operators import blocks, boilerplate, config, pagedom, robots
from skein.plans.fixtures import Fixtures
from skein.plans.fulltext import article_texts
from skein.plans.registry import load_all
from skein.session import PARSE_PARTITIONS, prepare
from skein.sources import dom, opml
from skein.sources import listing as listing_source

NOW = 1_704_067_200
URL = "https://a.example.com/list/"


@pytest.fixture
def pages(rows):
    def make(*htmls, url=URL):
        return rows("page_id bigint, url string, html string", [(i, url, h) for i, h in enumerate(htmls)])

    return make


def blocks_of(pages, html):
    p = pages(html)
    return pagedom.page_blocks(dom.dom_rows(p), p).orderBy("pos").collect()


def test_tree_intervals_and_implied_end_tags():
    root = dom.parse("<title>T</title><ul><li>a<li>b<ul><li>c</ul></ul><p>x<p>y<div>z</div><br>q")
    body = root.children[1]
    assert [c.tag for c in body.children] == ["ul", "p", "p", "div", "br", "#text"]
    ul = body.children[0]
    assert [c.tag for c in ul.children] == ["li", "li"]
    flat = [n for n, _ in dom.walk(root)]
    assert [n.pos for n in flat] == list(range(len(flat)))
    assert all(n.end == max(m.pos for m, _ in dom.walk(n)) for n in flat)


def test_blocks_drop_noise_and_keep_leaves(pages):
    got = blocks_of(
        pages,
        """<html><head><title>T</title></head><body>
        <header>site</header><nav><a href=/>home</a></nav><div class="main-menu">menu</div>
        <div id=content><h2 id="s1">One</h2><p class=x>First <b onclick=y>bold</b></p>
        <div><p>Second</p><p> </p></div><!-- c --><h2><a name="s2"></a>Two</h2><p><img src="i.png?utm_source=1" width=3></p>
        <div><div><div><div><header>deep</header></div></div></div></div>
        <p style="display: none">gone</p><p aria-hidden=true>gone</p></div></body></html>""",
    )
    assert [r.html for r in got] == [
        "<h2>One</h2>", "<p>First <b>bold</b></p>", "<p>Second</p>", '<h2><a></a>Two</h2>',
        '<p><img src="https://a.example.com/list/i.png"/></p>', "<div><header>deep</header></div>",
    ]
    assert [(r.anchor, r.head) for r in got] == [("", ""), ("s1", "One"), ("s1", "One"), ("s1", "One"), ("s2", "Two"), ("s2", "Two")]
    assert [r.text for r in got] == ["One", "First bold", "Second", "Two", "", "deep"]


def test_bare_ampersands_are_decoded_or_kept(pages):
    p = pages("<title>A &amp;&am</title><h1>a&amp;b &quot;the&amp</h1><p>AT&T <b>x &l</b></p><a href='?a&amp=1'>y</a>")

    def found(**how):
        nodes = dom.dom_rows(p, **how)
        texts = [r.text for r in pagedom.page_blocks(nodes, p).orderBy("pos").collect()]
        htmls = [r.html for r in pagedom.page_blocks(nodes, p).orderBy("pos").collect()]
        return texts[:2], htmls[:2], pagedom.page_titles(nodes).first().page_title

    kept = ["<h1>a&amp;b &#34;the&amp</h1>", "<p>AT&T <b>x &l</b></p>"]
    assert found(keep_bare=True) == (['a&b "the&amp', "AT&T x &l"], kept, "A &&am")
    decoded = ["<h1>a&amp;b &#34;the&amp;</h1>", "<p>AT&amp;T <b>x &amp;l</b></p>"]
    assert found() == (['a&b "the&', "AT&T x &l"], decoded, "A &&am")
    masked = pagedom.anonymized_pages(dom.dom_rows(p, keep_bare=True)).first().html
    assert "AT&T" not in masked


def test_signatures_are_bounded_only_where_a_limit_is_given(rows):
    n = boilerplate.MAX_SIGNATURES + 5
    state = rows("feed_id string, sig string, count bigint, last_seen bigint", [("f", f"s{i}", 1, 1) for i in range(n)])
    feeds, none = rows("feed_id string, pages bigint", [("f", 3)]), rows("feed_id string, sig string", [])
    assert boilerplate.observe_page(state, feeds, none)[0].count() == boilerplate.MAX_SIGNATURES
    assert boilerplate.observe_page(state, feeds, none, limit=None)[0].count() == n


def test_bare_text_is_one_block(pages):
    got = blocks_of(pages, "<body>just <i>text</i> &amp; more</body>")
    assert [r.html for r in got] == ["<body>just <i>text</i> &amp; more</body>"]
    assert blocks_of(pages, "<body><script>x</script> </body>") == []


def test_links_are_canonical(pages):
    got = blocks_of(pages, '<p><a href="/x?b=1&amp;a=2&amp;utm_medium=q" class=k>t</a></p>')
    assert got[0].html == '<p><a href="https://a.example.com/x?a=2&amp;b=1">t</a></p>'


def test_title_and_alternates(pages, as_set):
    p = pages(
        '<title> A  B </title><link rel="alternate" type="Application/RSS+xml " href="/feed" title="F">'
        '<link rel=stylesheet type="text/css" href=x><link rel="alternate" type="text/html" href=y>'
    )
    nodes = dom.dom_rows(p)
    assert as_set(pagedom.page_titles(nodes)) == {(0, "A B")}
    assert as_set(pagedom.alternate_feeds(nodes, p), "feed_url", "title") == {("https://a.example.com/feed", "F")}


def test_published_date_order_and_fallthrough(pages):
    ld = '<script type="application/ld+json">{}</script>'
    p = pages(
        '<meta property="article:published_time" content="2023-05-01T00:00:00Z"><time datetime="2023-01-01">',
        '<meta name="article:published_time" content="bad">' + ld.replace("{}", '{"@graph":[{"@type":"WebPage"},{"@type":["BlogPosting"],"datePublished":"2023-06-01"}]}'),
        ld.replace("{}", "not json") + '<body><time>x</time><time datetime="2023-07-01">',
        ld.replace("{}", '{"@type":"Article","datePublished":"2030-01-01"}'),
    )
    got = {r.page_id: r.published_at for r in pagedom.published_dates(dom.dom_rows(p), NOW).collect()}
    assert got == {0: 1682899200, 1: 1685577600, 2: 1688169600}


def test_inspect_elements_keep_safe_subset(pages):
    p = pages('<body><div id=d class="a b"><custom-x><p>lost</p></custom-x><img alt=A src=s><a href=/x style="background:url(e)">l</a></div><form><p>no</p></form>')
    got = pagedom.inspect_elements(dom.dom_rows(p)).orderBy("id").collect()
    assert [(r.id, r.parent_id, r.tag) for r in got] == [(1, 0, "div"), (2, 1, "img"), (3, 1, "a")]
    assert got[0].classes == ["a", "b"] and got[0].html_id == "d" and got[2].style == "background:"


PROSE = " ".join(f"word{i} lorem ipsum dolor sit amet." for i in range(30))
NAV = "<div class=top><ul>" + "".join(f'<li><a href="/n{i}">Navigation entry number {i}</a></li>' for i in range(8)) + "</ul></div>"


def article(i):
    return f"<html><body>{NAV}<div class=art><p>Article {i} {PROSE}</p><p>More {i} {PROSE}</p></div></body></html>"


def test_article_body_is_the_dense_container(pages):
    p = pages(article(1))
    got = pagedom.article_bodies(dom.dom_rows(p), p).first()
    assert "Article 1" in got.content and "Navigation entry" not in got.content and got.text_len > 200


def test_repeated_chrome_is_cut_from_the_third_page_on(pages):
    p = pages(*[article(i) for i in range(5)]).withColumn("feed_id", F.lit("f"))
    digests = dom.digest_rows(p, boilerplate.MAX_DEPTH, boilerplate.MIN_TEXT)
    numbered = boilerplate.number_pages(p.select("page_id", "feed_id"), "feed_id", "page_id")
    cut = boilerplate.removed_blocks(digests.join(numbered, "page_id"))
    assert sorted((r.page_id, r.pos) for r in cut.collect()) == [(2, 3), (3, 3), (4, 3)]
    texts = {r.page_id: r for r in article_texts(p).collect()}
    assert texts[1].stripped is False and texts[4].stripped is True
    assert all(f"Article {i}" in texts[i].content for i in range(5))


def test_repeated_prose_is_never_cut(pages):
    same = f"<div><p>Standing intro {PROSE}</p></div>"
    p = pages(*[same for _ in range(6)]).withColumn("feed_id", F.lit("f"))
    digests = dom.digest_rows(p, boilerplate.MAX_DEPTH, boilerplate.MIN_TEXT)
    numbered = boilerplate.number_pages(p.select("page_id", "feed_id"), "feed_id", "page_id")
    assert boilerplate.removed_blocks(digests.join(numbered, "page_id")).count() == 0


def test_signed_rows_agree_with_digests(pages, as_set):
    p = pages(article(1), article(2))
    signed = dom.dom_rows(p, signed=True).filter("in_body AND tag NOT IN ('#text', 'body') AND text_len >= 32 AND depth < 10")
    cols = ["page_id", "pos", "end", "sig", "text_len", "link_len"]
    assert as_set(signed, *cols) == as_set(dom.digest_rows(p, 10, 32), *cols)


@pytest.mark.parametrize(
    ("prev", "curr", "added", "removed"),
    [
        ("abc", "abcd", "d", ""), ("abc", "cab", "", ""), ("aab", "aaab", "a", ""), ("aaab", "ab", "", "aa"),
        ("", "xy", "xy", ""), ("xy", "", "", "xy"), ("abcd", "axcy", "xy", "bd"),
    ],
)
def test_block_diff(rows, prev, curr, added, removed):
    def side(keys):
        return rows("s int, pos int, key string", [(1, i, k) for i, k in enumerate(keys)])

    got = blocks.block_diff(side(prev), side(curr), ["s"]).orderBy("pos").collect()
    assert "".join(r.key for r in got if r.change == "added") == added
    assert "".join(r.key for r in got if r.change == "removed") == removed


def candidates_of(rows, html, **selectors):
    sel = {name: selectors.get(name) for name in listing_source.SELECTORS}
    schema = "page_id bigint, url string, html string, " + ", ".join(f"{n} string" for n in sel)
    page = rows(schema, [(1, URL, html, *sel.values())])
    matches = listing_source.listing_matches(page)
    return matches, listing_source.candidates(matches, page, NOW)


def test_listing_candidates(rows):
    html = """<div class=list>
      <article><a href="/1?utm_source=x#c">Read</a><h3>Title one</h3><time datetime="2023-05-01">May</time><p class=s>Sum</p></article>
      <article><a href="/pic"><img></a><a href="/2">A longer link text</a></article>
      <article><a href="/1">dup</a></article>
      <article>no link here</article>
      <article><a href="https://other.example.org/3">away</a></article>
      <article><a href="/list/">self</a></article>
      <article><div><article><a href="/4">inner</a></article></div></article></div>"""
    matches, cands = candidates_of(
        rows, html, item_selector="div.list > article", title_selector="h3", date_selector="time", summary_selector=".s"
    )
    got = cands.orderBy("pos").collect()
    assert [(r.url, r.title, r.published_at, r.summary) for r in got] == [
        ("https://a.example.com/1", "Title one", 1682899200, "Sum"), ("https://a.example.com/2", "A longer link text", None, ""),
        ("https://a.example.com/4", "inner", None, ""),
    ]
    warn = listing_source.listing_warnings(matches, cands).first()
    assert (warn.matched, warn.without_link, warn.duplicates) == (7, 1, 1)


@pytest.mark.parametrize(
    ("selector", "n"),
    [
        ("li", 4), ("ul > li", 4), ("#m li", 4), ("ul li.k", 1), ("li[data-x]", 1), ('li[data-x="1"]', 1), ("li[data-x=2]", 0),
        ("li:first-child", 1), ("li:nth-of-type(3)", 1), ("h1, li", 5), ("*", 2), ("div li", 0), ("body > ul", 1),
    ],
)
def test_selector_subset(rows, selector, n):
    html = '<h1><a href=/h>h</a></h1><ul id=m><li class="k j" data-x=1><a href=/1>1</a><li>2<li>3<li>4</ul>'
    matches, _ = candidates_of(rows, html, item_selector=selector)
    first = matches.first()
    # "*" matches the document's outermost element.
    assert first.matched == (1 if selector == "*" else n)


@pytest.mark.parametrize("selector", ["a:hover", "a::before", "a + b", "a ~ b", "", "a >", "[x^=y]", "x" * 201])
def test_selector_outside_the_subset_is_an_error(rows, selector):
    matches, _ = candidates_of(rows, "<a href=/x>x</a>", item_selector=selector)
    assert matches.first().error


def test_config_checks(rows):
    cfg = rows(
        "source_id bigint, config string",
        [
            (1, ""), (2, '{"ignore_patterns":["[0-9]+"],"watch_mode":"changes"}'), (3, '{"watch_mode":"x"}'), (4, '{"ignore_patterns":["("]}'),
            (5, '{"ignore_patterns":["(?=a)"]}'), (6, "{bad"), (7, '{"guid_mode":"never"}'),
        ],
    )
    got = {r.source_id: r.error for r in config.check_watch_config(cfg).collect()}
    assert got[1] is None and got[2] is None and all(got[i] for i in (3, 4, 5, 6, 7))
    lst = rows(
        "source_id bigint, config string",
        [
            (1, ""), (2, '{"item_selector":"li > a"}'), (3, '{"item_selector":"li:hover"}'), (4, '{"item_selector":"li","max_items_per_crawl":51}'),
            (5, '{"item_selector":"li","max_items_per_crawl":-1}'), (6, '{"item_selector":"' + "x" * 201 + '"}'),
        ],
    )
    got = {r.source_id: r.error for r in config.check_listing_config(lst).collect()}
    assert got[2] is None and all(got[i] for i in (1, 3, 4, 5, 6))


def test_opml_round_trip(rows, as_set):
    doc = """<?xml version="1.0" encoding="Shift_JIS"?><opml version="1.0"><body><outline text="外"><outline title="内">
      <outline title="A &amp; B" xmlUrl="https://a/rss" htmlUrl="https://a/"/></outline><outline text="C" xmlUrl="https://c/rss"/></outline>
      <outline text="D" xmlUrl="pagewatch:https://d/"/></body></opml>""".encode("cp932")
    docs = rows("user_id bigint, content binary", [(7, bytearray(doc)), (8, bytearray(b"<oops"))])
    got = opml.read_outlines(docs)
    assert as_set(got.filter("user_id = 7"), "folder", "title", "feed_url", "site_url") == {
        ("内", "A & B", "https://a/rss", "https://a/"), ("外", "C", "https://c/rss", ""), ("", "D", "pagewatch:https://d/", ""),
    }
    assert got.filter("user_id = 8").first().error
    kept = opml.import_rows(got.filter("error IS NULL"), 3)
    assert as_set(kept, "feed_url") == {("https://a/rss",), ("https://c/rss",)}
    assert opml.import_rows(got.filter("error IS NULL"), 2).count() == 0
    exported = rows(
        "user_id bigint, folder string, title string, feed_url string, site_url string, position bigint",
        [(7, "F", 'A & "B"', "https://a/rss", "https://a/", 1), (7, "", "C", "https://c/rss", "", 2)],
    )
    text = opml.render(exported).first().document
    again = opml.read_outlines(rows("user_id bigint, content binary", [(7, bytearray(text.encode()))]))
    assert as_set(again, "folder", "title", "feed_url") == {("F", 'A & "B"', "https://a/rss"), ("", "C", "https://c/rss")}


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [
        ("/a", "/abc", True), ("/a", "/b/a", False), ("/*.php$", "/a.php", True), ("/*.php$", "/a.php.php", False), ("/*.php$", "/a.php5", False),
        ("*", "/x", True), ("*/x", "/a/x", True), ("/a*b*c", "/a1b2c3", True), ("/a*b*c", "/a1c2b3", False), ("$", "/", False), ("/$", "/", True),
        ("/a.b", "/aXb", False), ("/(x)", "/(x)y", True),
    ],
)
def test_robots_patterns(spark, pattern, path, hit):
    regex = robots.rule_regex(F.lit(pattern))
    assert spark.range(1).select(F.rlike(F.lit(path), regex).alias("m")).first().m is hit


def test_robots_groups(rows):
    files = rows(
        "origin string, body string",
        [
            ("https://a.b", "User-agent: x\nUser-agent: SKEIN\nDisallow: /p\nAllow: /p/ok\nUser-agent: *\nDisallow: /\n"),
            ("https://c.d", "Disallow: /early\nUser-agent: *\nDisallow: /s # c\nDisallow:\n"), ("https://e.f", "User-agent: other\nDisallow: /"),
        ],
    )
    rules = robots.robots_rules(files, "skein")
    asked = rows("url string", [(u,) for u in (
        "https://a.b/p/x", "https://a.b/p/ok/1", "https://a.b/z", "https://c.d/s1", "https://c.d/early", "https://e.f/x", "https://g.h/x",
    )])
    got = {r.url for r in robots.robots_allowed(asked, rules).filter("NOT allowed").collect()}
    assert got == {"https://a.b/p/x", "https://c.d/s1"}


def test_anonymized_page(pages):
    p = pages('<body><p class="x">Hi 漢 &amp; 12</p><p>Keep me</p></body>')
    out = pagedom.anonymized_pages(dom.dom_rows(p), ["Keep"])
    assert '<p class="x">Aa 亜 &amp; 00</p><p>Keep me</p>' in out.first().html
    left = pagedom.unmasked_text(dom.dom_rows(out))
    assert left.first().n == 1


def test_sloppy_and_hostile_feeds(rows):
    from skein.sources.feeds import feed_items

    bodies = [
        (1, "https://a.example.com/", bytearray(b"<rss><channel><title>A&nbsp;& B</title><item><title>x &eacute;</title></item></channel></rss>")),
        (2, "https://b.example.com/", None),
        (3, "https://c.example.com/", bytearray(b'{"title": 5, "items": [{"id": 7, "url": 8, "title": ["t"]}]}')),
        (4, "https://d.example.com/", bytearray(b"<rss><channel>")),
        (5, "https://e.example.com/", bytearray(b"[" * 100_000)),
    ]
    got = {r.feed_id: r for r in feed_items(rows("feed_id bigint, feed_url string, body binary", bodies)).collect()}
    assert got[1].title == "x \u00e9" and got[1].feed_title == "A\u00a0& B"
    assert got[3].link == "8" and got[3].feed_title == "5"
    assert all(got[i].error and got[i].pos is None for i in (2, 4, 5))


def test_python_gets_pages_in_batches_bounded_by_bytes(spark, rows):
    prepare(spark)
    big = rows("id bigint, html string", [(i, "x" * (1 << 20)) for i in range(24)]).coalesce(1)

    def sizes(batches):
        for b in batches:
            yield b.iloc[:1].assign(html=str(len(b)))

    assert max(int(r.html) for r in big.mapInPandas(sizes, "id bigint, html string").collect()) <= 9


def _parses(df):
    return df._jdf.queryExecution().executedPlan().toString().count("MapInPandas")


def test_blocks_parse_pages_once(pages):
    p = pages("<body><p id='x'>One</p><h2 id='y'>Two</h2><p>Three</p></body>")
    found = pagedom.page_blocks(dom.dom_rows(p), p)
    assert _parses(found) == 1
    got = [(r.text, r.is_heading, r.anchor) for r in found.orderBy("pos").collect()]
    assert got == [("One", False, ""), ("Two", True, ""), ("Three", False, "y")]


def test_dates_parse_pages_once(pages):
    p = pages("<time datetime='2020-01-07'>x</time>", "<script type='application/ld+json'>{\"@type\":\"Article\",\"datePublished\":\"2020-01-06\"}</script>")
    found = pagedom.published_dates(dom.dom_rows(p), NOW)
    assert _parses(found) == 0  # the rows that matter were kept by one parse before
    assert found.count() == 2


def test_removed_boilerplate_parses_pages_once(spark):
    found = load_all()["removed_boilerplate"].run(Fixtures(prepare(spark), "/root/testdata/sf0.001"))
    assert _parses(found) == 0


def test_one_row_group_is_parsed_by_many_tasks(spark, pages):
    p = pages(*[f"<body><p>{i}</p></body>" for i in range(64)]).coalesce(1)
    prepare(spark)
    one = dom.dom_rows(p).select("page_id", F.spark_partition_id().alias("at")).distinct()
    assert one.select("at").distinct().count() > 1
    spark.conf.set(PARSE_PARTITIONS, "0")
    try:
        assert dom.dom_rows(p).rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset(PARSE_PARTITIONS)
