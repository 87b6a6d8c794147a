"""Frontiers over several sitemaps, and what is left out of them."""

import random

import pytest

from pagetables.config import work_folder
from pagetables.operators.routing import invalid_candidates
from pagetables.operators.sitemap import crawl_frontier, crawl_run_frontier, failed_sitemaps
from pagetables.sources.readers import read_sitemaps

SITEMAP = "sitemap_url string, http_status int, xml string, fetched_at timestamp"


def sitemaps_of(spark, rng, n):
    rows = []
    for i in range(n):
        urls = [f"https://e.com/{rng.randrange(9)}" for _ in range(rng.randrange(6))]
        rows.append((f"map{i % (n - 3):03}", 200, "".join(f"<loc>{url}</loc>" for url in urls), None))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, SITEMAP).repartition(5)


@pytest.mark.parametrize("limit", [0, 1, 7, 40, 10_000, "12", "0x10", "none", "Infinity"])
def test_limit_over_a_run(spark, limit):
    rows, frame = sitemaps_of(spark, random.Random(5), 30)
    got = [(r.sitemap_url, r.pos, r.url) for r in crawl_run_frontier(frame, limit).collect()]
    whole = [(name, pos, url) for name, _, xml, _ in rows for pos, url in enumerate(xml[5:-6].split("</loc><loc>") if xml else [])]
    count = {"12": 12, "0x10": 16, "none": 0, "Infinity": len(whole)}.get(limit, limit)
    assert len(got) == min(count, len(whole))
    # sitemaps of one name follow each other in any order
    names = sorted(name for name, *_ in whole)[: len(got)]
    assert sorted(name for name, *_ in got) == names
    assert set(got) <= set(whole)
    complete = {name for name in names if names and name != names[-1]}
    assert sorted(x for x in got if x[0] in complete) == sorted(x for x in whole if x[0] in complete)


def test_limits_of_a_sitemap(spark):
    _, frame = sitemaps_of(spark, random.Random(6), 9)
    assert crawl_frontier(frame, "0x2").count() == crawl_frontier(frame, 2).count()
    assert crawl_frontier(frame, "1_0").count() == 0
    with pytest.raises(ValueError):
        crawl_run_frontier(frame, -1)


def test_sitemaps_that_failed(spark):
    path = work_folder(spark, "sitemaps")
    rows = [("a", 200, "<loc>https://e.com/</loc>", None), ("b", 404, "<loc>x</loc>", None), ("c", None, None, None)]
    spark.createDataFrame(rows, SITEMAP).write.parquet(path)
    assert [r.sitemap_url for r in read_sitemaps(spark, path).collect()] == ["a"]
    assert {r.sitemap_url for r in failed_sitemaps(spark.read.parquet(path)).collect()} == {"b", "c"}


def test_invalid_urls_of_a_frontier(spark):
    xml = "<loc>https://e.com/a</loc><loc>no url</loc>"
    frontier = crawl_frontier(spark.createDataFrame([("a", xml)], "sitemap_url string, xml string"))
    assert [r.url for r in invalid_candidates(frontier).collect()] == ["no url"]
