"""Routing decisions, warm-ups and replay."""

import random

import pytest
from pyspark.sql import functions as F

from pagetables.operators.routing import crawl_candidates, route_requests, route_requests_asof, serve_coverage, warmup_queue

AGENT, BROWSER = "GPTBot/1.0", "Mozilla/5.0 Chrome/125"
REQUEST = "request_id bigint, ts string, method string, url string, user_agent string, accept string"
RECORD = "key string, url string, status string, generated_at string, markdown string"


def requests_of(spark, *rows):
    table = spark.createDataFrame([(i, *row, None) for i, row in enumerate(rows)], REQUEST)
    return table.withColumn("ts", F.col("ts").cast("timestamp"))


def records_of(spark, *rows):
    return spark.createDataFrame(rows, RECORD).withColumn("generated_at", F.col("generated_at").cast("timestamp"))


PRICING = "https://example.com/pricing"
NOON = "2024-01-01 12:00:00"


@pytest.fixture(scope="module")
def decided(spark):
    requests = requests_of(
        spark,
        (NOON, "GET", PRICING + "?utm=1#x", AGENT),
        (NOON, "HEAD", PRICING, AGENT),
        (NOON, "POST", PRICING, AGENT),
        (NOON, "GET", PRICING, BROWSER),
        (NOON, "GET", "https://example.com/logo.png", AGENT),
        (NOON, "GET", "https://example.com/new", AGENT),
        (NOON, "HEAD", "https://example.com/new", AGENT),
        (NOON, "GET", "https://example.com/failed", AGENT),
        (NOON, "GET", "https://example.com/moved", AGENT),
        (NOON, "GET", "not a url", AGENT),
    )
    records = records_of(
        spark,
        ("page:" + PRICING, None, "ready", "2024-01-01 00:00:00", "# Pricing"),
        ("page:https://example.com/failed", None, "failed", "2024-01-01 00:00:00", None),
        ("page:https://example.com/moved", "https://Example.com/now?x#y", "stale", "2024-01-01 00:00:00", "# Now"),
        ("page:https://example.com/logo.png", None, "ready", "2024-01-01 00:00:00", "# Logo"),
    )
    return requests, records, route_requests(requests, records, "2024-01-02 00:00:00")


def test_decisions(decided):
    rows = {row.request_id: row for row in decided[2].collect()}
    assert [rows[i].decision for i in range(10)] == [
        "serve_markdown",
        "serve_markdown",
        "passthrough",
        "passthrough",
        "passthrough",
        "origin_warm",
        "origin",
        "origin",
        "serve_markdown",
        "passthrough",
    ]
    served = rows[0]
    assert (served.content_type, served.resource_state) == ("text/markdown; charset=utf-8", "ready")
    assert (served.canonical_url, served.markdown_length) == (PRICING, 9)
    assert (rows[8].canonical_url, rows[8].resource_state) == ("https://example.com/now", "stale")
    assert rows[3].content_type is None and rows[5].canonical_url is None


def test_coverage_and_warmups(spark, decided):
    requests, records, routed = decided
    assert [tuple(row) for row in serve_coverage(routed).collect()] == [("GPTBot", 6, 3, 2, 1, 0.5)]
    misses = warmup_queue(requests, records)
    assert [(row.key, row.url, row.requests) for row in misses.collect()] == [
        ("page:https://example.com/new", "https://example.com/new", 1)
    ]
    frontier = spark.createDataFrame([("https://example.com/new?a",), ("https://example.com/b",), ("bad",)], "url string")
    assert {tuple(row) for row in crawl_candidates(frontier, misses).collect()} == {
        ("page:https://example.com/new", "https://example.com/new", "miss,sitemap"),
        ("page:https://example.com/b", "https://example.com/b", "sitemap"),
    }


@pytest.mark.parametrize("bucket_seconds, salts", [(60, 1), (7, 3), (86_400, 10)])
def test_replay_equals_brute_force(spark, bucket_seconds, salts):
    """A third of all requests and records belong to one page."""
    chance = random.Random(7)
    page = lambda: "hot" if chance.random() < 0.34 else f"p{chance.randrange(6)}"
    time = lambda: f"2024-01-01 00:{chance.randrange(20):02d}:{chance.randrange(60):02d}"
    requests = [(time(), "GET", f"https://e.com/{page()}", AGENT) for _ in range(300)]
    versions = {(page(), time()): chance.choice(["ready", "failed"]) for _ in range(80)}
    records = [(f"page:https://e.com/{p}", None, s, t, f"# {p} {t}") for (p, t), s in versions.items()]

    routed = route_requests_asof(
        requests_of(spark, *requests), records_of(spark, *records), 168, bucket_seconds, salts
    )
    got = {row.request_id: (row.decision, row.resource_state) for row in routed.collect()}

    def brute_force(at, url):
        earlier = [(t, s) for (p, t), s in versions.items() if url.endswith("/" + p) and t <= at]
        if not earlier:
            return "origin_warm", None
        return ("serve_markdown", "ready") if max(earlier)[1] == "ready" else ("origin", None)

    assert got == {i: brute_force(at, url) for i, (at, _, url, _) in enumerate(requests)}
