"""Sitemaps, links, metadata, tables, Markdown, documents and crawl records."""

import pytest
from pyspark.sql import functions as F

from pagetables.operators.content import content_profile, page_content
from pagetables.operators.documents import build_documents, crawl_pages, dead_letters
from pagetables.operators.links import link_graph, uncrawled_links
from pagetables.operators.metadata import page_metadata
from pagetables.operators.render import render_markdown
from pagetables.operators.sitemap import crawl_frontier, failed_sitemaps, fetched_sitemaps, sitemap_urls
from pagetables.operators.tables import html_tables

TIME = "2026-06-03 00:00:00"
PAGES = "page_id bigint, url string, html string"


def pages_of(spark, *htmls, url="https://example.com/docs/start?ref=a#b"):
    return spark.createDataFrame([(i, url, html) for i, html in enumerate(htmls)], PAGES)


def markdown_of(spark, *bodies, url="https://example.com/docs/start?ref=a#b"):
    rows = render_markdown(pages_of(spark, *[f"<main>{body}</main>" for body in bodies], url=url))
    return [(row.markdown, row.error) for row in rows.orderBy("page_id").collect()]


# --- sitemaps ---------------------------------------------------------------------------


def test_sitemap_urls(spark):
    xml = """<urlset><url><loc> https://example.com/ </loc></url>
      <url><LOC>https://example.com/a?x=1&amp;y=2</LOC></url><loc></loc><loc>
      https://example.com/ </loc><loc>&amp;lt;</loc><loc>unclosed"""
    rows = spark.createDataFrame([(1, xml)], "sitemap_id int, xml string")
    urls = ["https://example.com/", "https://example.com/a?x=1&y=2", "https://example.com/", "<"]
    assert [tuple(row) for row in sitemap_urls(rows).collect()] == [(1, i, url) for i, url in enumerate(urls)]
    assert crawl_frontier(rows, "2").count() == 2
    assert crawl_frontier(rows).count() == 4
    assert crawl_frontier(rows, "many").count() == 0
    with pytest.raises(ValueError):
        crawl_frontier(rows, -1)


def test_failed_sitemaps_are_reported(spark):
    rows = spark.createDataFrame([("a", 200), ("b", 404), ("c", None)], "sitemap_url string, http_status int")
    assert [row.sitemap_url for row in fetched_sitemaps(rows).collect()] == ["a"]
    assert [row.sitemap_url for row in failed_sitemaps(rows).collect()] == ["b", "c"]


# --- links ---------------------------------------------------------------------------------


def test_links(spark):
    html = """<nav><a href="/harbour">Harbour</a></nav><a class="c" href='https://example.com/tides?day=3#noon'>Tides</a>
      <a href="https://boats.example.org/hire">Hire</a><a href="/chart.PNG">Chart</a><a href="/notice.woff2">Font</a>
      <a href=/unquoted>u</a><a href="#deck">t</a><a href="mailto:a@b.c">m</a><a href="MAILTO:a@b.c">m</a>
      <a href="tel:1">t</a><a href="">e</a><a href="http://">bad</a><a href="http://example.com/">plain</a>
      <a href="next?a=1&amp;b=2">n</a><a href=" /harbour#again ">p</a><!-- <a href="/hidden">h</a> -->
      <a data-href="/first" href="/last">l</a><a href="/für">f</a><article href="/no">"""
    rows = link_graph(pages_of(spark, html)).orderBy("link_no").collect()
    assert {row.source for row in rows} == {"https://example.com/docs/start"}
    paths = ["/harbour", "/tides", "/docs/next", "/hidden", "/last", "/f%C3%BCr"]
    assert [(row.link_no, row.target) for row in rows] == [
        (i, f"https://example.com{path}") for i, path in enumerate(paths)
    ]


def test_pages_with_a_bad_url_have_no_links(spark):
    assert link_graph(pages_of(spark, '<a href="https://example.com/">x</a>', url="nowhere")).count() == 0


def test_uncrawled_links(spark):
    edges = spark.createDataFrame(
        [("s1", "https://e.com/a"), ("s1", "https://e.com/b"), ("s2", "https://e.com/b")], "source string, target string"
    )
    known = spark.createDataFrame([("page:https://e.com/a",)], "key string")
    assert [tuple(row) for row in uncrawled_links(edges, known).collect()] == [
        ("page:https://e.com/b", "https://e.com/b", 2)
    ]


# --- metadata --------------------------------------------------------------------------------


def test_metadata(spark):
    rows = page_metadata(
        pages_of(
            spark,
            '<title> A <b>b</b> &amp;\n c </title><link rel="Alternate CANONICAL" href="https://c.example.com/x?y#z">'
            '<link rel="canonical" href="/second"><meta name="Description" content=" One &amp; two ">'
            '<meta name="description" content="later">',
            '<link rel="canonicals" href="/x"><meta name="description"><meta name="description" content="later">',
            '<link rel="canonical" href="/relative">',
            '<link rel="canonical" href="">',
            '<link rel="canonical"><title>&#99999999;</title>',
            '<!-- <title>hidden</title> --><script><title>no</title></script>',
            url="https://example.com/docs/getting-started_now%20x.html/?ref=a",
        )
    )
    got = [tuple(row)[1:] for row in rows.orderBy("page_id").collect()]
    page, title = "https://example.com/docs/getting-started_now%20x.html/", "Getting Started Now%20x.Html"
    assert got == [
        ("https://c.example.com/x", "A b & c", "One & two", None),
        (page, title, "", None),
        (None, None, None, "Invalid URL"),
        (None, None, None, "Invalid URL"),
        (None, None, None, "Invalid code point 99999999"),
        (page, title, "", None),
    ]


def test_title_falls_back_to_the_host(spark):
    rows = page_metadata(pages_of(spark, "<p>x</p>", url="https://www.example.com:8080/?q"))
    assert rows.first().title == "www.example.com"


# --- content -----------------------------------------------------------------------------------


def test_regions_and_cleaning(spark):
    htmls = [
        "<body>a<main id=m>b<nav>n</nav><svg>s</svg></main><article>c</article></body>",
        "<body>a<ARTICLE>b</ARTICLE></body>",
        "<body>a<section role='main' x>b</section></body>",
        "<body>a<aside>x</aside><!-- c --><script>s</script></body>",
        "bare<style>s</style>",
        "<main></main><article>c</article>",
        "a<!-- <script> -->b</script>c",
    ]
    rows = pages_of(spark, *htmls).select("page_id", page_content("html").alias("c")).orderBy("page_id")
    assert [(row.c.region, row.c.html) for row in rows.collect()] == [
        ("main", "b"),
        ("article", "b"),
        ("role", "b"),
        ("body", "a"),
        ("whole", "bare"),
        ("main", ""),
        ("whole", "a<!-- c"),
    ]
    profile = content_profile(pages_of(spark, "<main>1234</main>", "<main></main>")).collect()
    assert [tuple(row) for row in profile] == [("example.com", "main", 2, 30, 4, 26 / 30)]


def test_tables(spark):
    html = """<main><table><tr><th>Gate</th><td>Depth</td></tr><tr></tr>
      <tr class=x><td> <b>A</b> &amp; b </td></tr></table><table><tr></tr></table>
      <TABLE><tr><td>1</td><td>2</td><th>3</th></tr></TABLE></main>"""
    rows = html_tables(pages_of(spark, html)).orderBy("table_no", "row_no").collect()
    assert [(row.table_no, row.row_no, row.cells) for row in rows] == [
        (0, 0, ["Gate", "Depth"]),
        (0, 1, ["A & b", ""]),
        (1, 0, ["1", "2", "3"]),
    ]


# --- Markdown ------------------------------------------------------------------------------------


def test_blocks(spark):
    body = """<h1>Top <i>title</i></h1><p>One<br/>two &copy; &amp;lt;b&amp;gt;</p><ol><li>first</li><li>second
      line</li></ol><div>a</div><section>b</section><h2 class=x>Sub</h3>c</h2><nav>n</nav>tail"""
    assert markdown_of(spark, body) == [
        (
            "# Top title\n\nOnetwo &copy;\n\n- first\n\n- second line\n\na\n\nb\n\n## Subc\n\ntail",
            None,
        )
    ]


def test_decoded_tags_in_a_paragraph_are_stripped(spark):
    assert markdown_of(spark, "<p>&lt;b&gt;x&lt;/b&gt; y</p>z &lt;b&gt;") == [("x y\n\nz <b>", None)]


def test_tables_in_markdown(spark):
    body = "<table><tr><th>Gate</th><th>Depth</th></tr><tr><td><a href='/a'>A</a></td></tr></table>x<table></table>y"
    assert markdown_of(spark, body) == [("| Gate | Depth |\n| --- | --- |\n| A |  |\n\nx\ny", None)]


def test_anchors(spark):
    body = """<a href="/x y?q=1#h">One</a> <a>Two</a> <a href="">Three</a> <a href="/e"> </a>|
      <a href="mailto:a@b.c"><b>Mail</b></a> <a href='../up'>Up</a> <a data-href="/d" href="/r">D</a>"""
    assert markdown_of(spark, body) == [
        (
            "[One](https://example.com/x%20y?q=1) Two Three |\n"
            "[Mail](mailto:a@b.c) [Up](https://example.com/up) [D](https://example.com/d)",
            None,
        )
    ]


def test_links_resolve_against_the_canonical_url(spark):
    html = '<link rel="canonical" href="https://c.example.com/a/b"><main><a href="d">x</a></main>'
    assert render_markdown(pages_of(spark, html)).first().markdown == "[x](https://c.example.com/a/d)"


def test_block_anchors(spark):
    card = '<a aria-label="Read {0}" href="/f"><section><h4>Moorings</h4><ul><li>Six berths</li></ul></section>{1}</a>'
    assert markdown_of(
        spark,
        card.format("on", "<p><em>View berths</em></p>"),
        card.format("on", ""),
        '<a href="/f"><h3>Title</h3></a>',
        '<a><p>Learn more</p><p>Learn more</p></a>',
        '<a href="/f"><ul><li>Learn one</li></ul><p>Try two</p><p>Learned</p></a>',
        f'<a href="/f"><p>Start {"x" * 80}</p></a>',
        'a<a href="/f"><table><tr><td>View it</td></tr></table></a>b',
    ) == [
        ("#### Moorings\n\n- Six berths\n\n[View berths](https://example.com/f)", None),
        ("#### Moorings\n\n- Six berths\n\n[Read on](https://example.com/f)", None),
        ("### Title\n\n[Open page](https://example.com/f)", None),
        ("", None),
        ("- Learn one\n\nLearned\n\n[Try two](https://example.com/f)", None),
        (f"Start {'x' * 80}\n\n[Open page](https://example.com/f)", None),
        # The table is text by then, so the anchor is not a block.
        ("a[| View it | | --- |](https://example.com/f)b", None),
    ]


def test_failures(spark):
    assert markdown_of(
        spark,
        '<a href="http://">x</a>',
        '<a href="http://"> </a>',
        '<a href="http://"><div>x</div></a>',
        "<p>&#1114112;</p>",
        '<table><tr><td>&#1114113;</td></tr></table><a href="http://">x</a>',
        "<a aria-label='&#1114114;'><div>x</div></a>",
    ) == [
        (None, "Invalid URL"),
        ("", None),
        (None, "Invalid URL"),
        (None, "Invalid code point 1114112"),
        (None, "Invalid code point 1114113"),
        (None, "Invalid code point 1114114"),
    ]


# --- documents ------------------------------------------------------------------------------------

TIDES = """<html><head><meta content="High and low water for the coming week." name="description">
<script type="application/ld+json">{"@type":"Organization","name":"Ellery Harbour Office","url":"/office"}</script>
<title>Tides at Port Ellery</title><link href="https://harbour.example/tides?week=23" rel="canonical"></head>
<body><aside>Gale warning</aside><main><h2>This week</h2><p>Times are in <em>local</em> time.</p>
<table><tr><th>Day</th><th>High</th></tr><tr><td>Mon</td><td>04:12</td></tr></table>
<p>Ask the <a href="ask">harbour office</a> before you sail.</p></main></body></html>"""

TIDES_DOCUMENT = """# Tides at Port Ellery

Canonical URL: https://harbour.example/tides
Last generated: 2026-06-03T00:00:00.000Z
Source: public HTML

## Description
High and low water for the coming week.

## Structured Data
### Organization
Name: Ellery Harbour Office
URL: https://harbour.example/office

## Content
## This week

Times are in local time.

| Day | High |
| --- | --- |
| Mon | 04:12 |

Ask the [harbour office](https://harbour.example/ask) before you sail.
"""


def test_documents(spark):
    rows = build_documents(
        pages_of(spark, TIDES, "<main><h1>T</h1><ul><li>i</li></ul>First line.</main>", "<main></main>", "", None),
        TIME,
    ).orderBy("page_id")
    got = rows.collect()
    assert got[0].markdown == TIDES_DOCUMENT
    assert got[1].description == "First line."
    assert got[1].markdown.startswith("# Start\n\nCanonical URL: https://example.com/docs/start\n")
    assert got[2].markdown.endswith(
        "## Description\nNo description found.\n\n## Content\nNo extractable content found.\n"
    )
    assert [row.error for row in got] == [None, None, None] + ["empty-html"] * 2


def test_crawl_records(spark):
    html = "<title>Locks</title><main><h3>Canal locks</h3></main>"
    cases = [
        ("https://example.com/locks?x#y", 200, "text/html", html, None),
        ("https://example.com/depths", 200, "image/svg+xml", "<svg/>", None),
        ("https://example.com/gone", 404, "application/pdf", html, None),
        ("https://example.com/down", 500, "text/html", html, "fetch failed"),
        ("https://example.com/empty", 204, "Text/HTML; charset=utf-8", "", None),
        ("https://example.com/none", 200, None, html, None),
        ("https://example.com/link", 200, "text/html", html + '<link rel="canonical" href="/c">', None),
        ("no url", 200, "text/html", html, None),
    ]
    responses = spark.createDataFrame(
        cases, "url string, http_status int, content_type string, html string, fetch_error string"
    )
    rows = {row.key: row for row in crawl_pages(responses, TIME).collect()}
    ready = rows.pop("page:https://example.com/locks")
    assert (ready.status, ready.url, ready.reason) == ("ready", "https://example.com/locks", None)
    assert ready.markdown.startswith("# Locks\n")
    assert {key.rsplit("/", 1)[1]: row.reason for key, row in rows.items()} == {
        "depths": "unsupported-content-type",
        "gone": "http-404",
        "down": "fetch failed",
        "empty": "empty-html",
        "none": "unsupported-content-type",
        "link": "Invalid URL",
    }
    assert {row.status for row in rows.values()} == {"failed"} and not any(row.markdown for row in rows.values())
    assert [row.url for row in dead_letters(responses).collect()] == ["no url"]


def test_filters_on_results_do_not_multiply_the_work(spark):
    ready = build_documents(pages_of(spark, TIDES), TIME).filter(F.col("error").isNull() & (F.col("title") != ""))
    assert ready.count() == 1
