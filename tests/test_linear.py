"""Rules over hostile pages and URLs: no deep recursion, time in proportion to the text."""

import time

import pytest
from pyspark.sql import functions as F

from pagetables.functions.text import inline_text
from pagetables.functions.urls import page_url
from pagetables.operators.content import clean_page, main_content, page_content
from pagetables.operators.links import link_hrefs
from pagetables.operators.metadata import canonical_href, meta_description, title_text
from pagetables.operators.render import _AFTER_ANCHORS
from pagetables.operators.sitemap import sitemap_locations
from pagetables.operators.structured import _parse_scripts
from pagetables.operators.tables import table_rows

HEADINGS, ITEMS, PARAGRAPHS, REST = _AFTER_ANCHORS


def seconds(spark, rule, piece, size):
    text = (piece * (size // len(piece) + 1))[:size]
    frame = spark.createDataFrame([(text,)], "html string").select(F.length(rule(F.col("html").cast("string")).cast("string")))
    start = time.perf_counter()
    frame.collect()
    return time.perf_counter() - start


@pytest.mark.parametrize(
    "rule, piece",
    [
        (clean_page, "<svg/>"),
        (clean_page, "<svg "),
        (clean_page, "<!-- "),
        (clean_page, "<script>"),
        (lambda html: page_content(html)["html"], "<nav>x"),
        (lambda html: main_content(html)["html"], "<main>"),
        (lambda html: main_content(html)["html"], "<article "),
        (lambda html: main_content(html)["html"], '<div role="main">'),
        (lambda html: main_content(html)["html"], '<div role="main"'),
        (lambda html: main_content(html)["html"], '<p role="main"></q>'),
        (HEADINGS, "<h2>x"),
        (ITEMS, "<li>x"),
        (PARAGRAPHS, "<p "),
        (REST, "<div "),
        (inline_text, "<"),
        (title_text, "<title>"),
        (canonical_href, "<link "),
        (meta_description, "<meta "),
        (table_rows, "<tr><td>"),
        (table_rows, "</tr><tr "),
        (sitemap_locations, "<loc>"),
        (sitemap_locations, "<loc> </loc>" + " " * 400),
        (link_hrefs, "<a "),
        (link_hrefs, "<a href="),
        (link_hrefs, "<a href='/x' <a "),
    ],
)
def test_time_grows_with_the_page(spark, rule, piece):
    seconds(spark, rule, piece, 10_000)
    small, large = (seconds(spark, rule, piece, size) for size in (40_000, 160_000))
    assert large < 8 * small + 1


def test_scripts_with_many_brackets(spark):
    text = "<script type='application/ld+json'>" + "[" * 50 + "]" * 50 + "</script>" + '<script type="application/ld+json">[' * 20_000
    frame = spark.createDataFrame([(text,)], "html string").select(_parse_scripts().alias("s"))
    assert [s["levels"] for s in frame.first()["s"]][:1] == [50]


def test_brackets_in_strings_are_no_levels(spark):
    text = r"""<script type="application/ld+json">{"a":"[[\"[[","b":[1,[2]],"c":"]]]\\","d":[[[3]]]}</script>"""
    frame = spark.createDataFrame([(text,)], "html string").select(_parse_scripts().alias("s"))
    assert [s["levels"] for s in frame.first()["s"]] == [3]


@pytest.mark.parametrize("labels", [1_000, 100_000])
def test_hosts_of_many_labels(spark, labels):
    host = "a." * labels + "example"
    rows = [(f"https://{host}/x?y",), (f"https://{host}..b/x",), (f"https://.{host}/x",), ("https://a" + "/b" * labels,)]
    got = [r[0] for r in spark.createDataFrame(rows, "url string").select(page_url("url")).collect()]
    assert got[0] == f"https://{host}/x" and got[3] == "https://a" + "/b" * labels


def test_unclosed_roles_of_a_megabyte(spark):
    text = '<div role="main">' * 60_000
    frame = spark.createDataFrame([(text,), (text + "x</div>",)], "html string").select(main_content("html").alias("c"))
    assert [(row.c["region"], len(row.c["html"])) for row in frame.collect()] == [
        ("whole", len(text)),
        ("role", len(text) - len('<div role="main">') + 1),
    ]


@pytest.mark.parametrize("tail", ["/..", "/%2E.", "/.", "/../b"])
def test_time_grows_with_dot_segments(spark, tail):
    def url(n):
        return "https://a.example" + "/a" * n + tail * n

    def timed(n):
        frame = spark.createDataFrame([(url(n),)], "url string").select(page_url("url"))
        start = time.perf_counter()
        frame.collect()
        return time.perf_counter() - start

    timed(2_000)
    small, large = timed(50_000), timed(100_000)
    assert large < 3 * small + 1


def test_long_segments_and_blanks(spark):
    long = "a" * 200_000
    rows = [(f"https://a.example/{long}/b/../c",), (f"https://a.example/x{' ' * 200_000}y",)]
    start = time.perf_counter()
    got = [row[0] for row in spark.createDataFrame(rows, "url string").select(page_url("url")).collect()]
    assert got == [f"https://a.example/{long}/c", "https://a.example/x" + "%20" * 200_000 + "y"]
    assert time.perf_counter() - start < 30
