"""Links between pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import scrub
from ..functions.text import LINE_ENDS, NOT_WORD_AHEAD, SPACE, decode_xml, first_in_stretch, rearm, trim_space
from ..functions.urls import ASSET_PATTERN, parse_url, resolve_urls, url_text

# The last quoted href of an anchor tag; group 2 is the value.
_HREF = rf"(?i)<a{NOT_WORD_AHEAD}[^>]*href[{SPACE}]*=[{SPACE}]*([\"'])([^{LINE_ENDS}]*?)\1"
_SKIPPED = r"\A(?:#|mailto:|tel:|\z)"


def link_hrefs(html: Column) -> Column:
    """Distinct hrefs that can lead to a page, in first-seen order."""
    hrefs = F.transform(
        F.regexp_extract_all(first_in_stretch(scrub(html), "a"), F.lit(_HREF), F.lit(2)),
        lambda href: decode_xml(trim_space(rearm(href))),
    )
    return F.array_distinct(F.filter(hrefs, lambda href: ~F.rlike(href, F.lit(_SKIPPED))))


def _page_targets(urls: Column, origin: Column) -> Column:
    """Distinct same-origin page URLs of parsed URLs."""

    def target(url: Column) -> Column:
        wanted = (url.origin == origin) & url.scheme.isin("http", "https")
        return F.when(
            wanted & ~F.rlike(url.path, F.lit(ASSET_PATTERN)), url_text(url, query=False)
        )

    return F.array_distinct(F.filter(F.transform(urls, target), lambda url: url.isNotNull()))


def link_graph(pages: DataFrame) -> DataFrame:
    """Edges page to page.  Pages with an invalid URL have none.

    Links are resolved and made distinct inside the page's row, without a shuffle.
    """
    listed = pages.select("page_id", parse_url("url").alias("base"), link_hrefs(F.col("html")).alias("hrefs"))
    resolved = listed.filter(F.col("base").isNotNull()).withColumn("urls", resolve_urls("hrefs", "base"))
    return resolved.select(
        "page_id",
        url_text(F.col("base"), query=False).alias("source"),
        F.posexplode(_page_targets(F.col("urls"), F.col("base.origin"))).alias("link_no", "target"),
    )


def link_in_degree(links: DataFrame) -> DataFrame:
    """Number of linking pages and of links per target."""
    return links.groupBy("target").agg(
        F.count_distinct("source").alias("linking_pages"), F.count("*").alias("links")
    )


def uncrawled_links(links: DataFrame, resources: DataFrame) -> DataFrame:
    """Link targets without a record.  Edges are counted per target before the join."""
    targets = link_in_degree(links).withColumn("key", F.concat(F.lit("page:"), "target"))
    return targets.join(resources.select("key"), "key", "left_anti").select(
        "key", F.col("target").alias("url"), "linking_pages"
    )
