"""Cleaning of HTML and choice of the main content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cache import by_name
from ..functions.exprs import let, scrub, up_to_last
from ..functions.text import NOT_WORD_AHEAD, disarm, element, rearm
from ..functions.urls import page_url, url_host

# Elements without readable content, and blocks left out of a page.
NON_CONTENT_TAGS = ("script", "style", "noscript", "template", "svg", "canvas", "iframe")
DROPPED_BLOCKS = ("nav", "footer", "aside")

_COMMENT = r"(?s)<!--.*?-->"
_HAS_ROLE = r"(?i)role=[\"']main[\"']"
_BEFORE_ROLE = r"(?is)\A(.*)role=[\"']main[\"']"
_OPENING = rf"(?i)<([a-z0-9-]+){NOT_WORD_AHEAD}"
_CLOSING = r"(?i)</([a-z0-9-]+)>\z"


def _remove(html: Column, tags: tuple[str, ...]) -> Column:
    for tag in tags:
        html = rearm(F.regexp_replace(disarm(html, tag), element(tag), ""))
    return html


def _remove_if_any(html: Column, tags: tuple[str, ...]) -> Column:
    """Remove elements, one tag after another; one test spares pages without any."""
    any_tag = rf"(?i)<(?:{'|'.join(tags)}){NOT_WORD_AHEAD}"
    return let(html, lambda h: F.when(F.rlike(h, F.lit(any_tag)), _remove(h, tags)).otherwise(h))


def remove_non_content(html: Column) -> Column:
    """Without non-content elements, then without comments."""
    common, rare = NON_CONTENT_TAGS[:2], NON_CONTENT_TAGS[2:]
    return up_to_last(
        _remove_if_any(_remove_if_any(html, common), rare), "-->", lambda head: F.regexp_replace(head, _COMMENT, "")
    )


def remove_dropped_blocks(html: Column) -> Column:
    return _remove_if_any(html, DROPPED_BLOCKS)


def strip_boilerplate(html: Column) -> Column:
    return remove_dropped_blocks(remove_non_content(html))


def _inside(html: Column, region: str, pattern: str, group: int) -> Column:
    """``struct<region, html>`` of the first match, NULL if there is none."""
    return let(
        F.regexp_extract(html, pattern, 0),
        lambda whole: F.when(
            whole != "",
            F.struct(F.lit(region).alias("region"), rearm(F.regexp_extract(whole, pattern, group)).alias("html")),
        ),
    )


def _inside_role_main(html: Column) -> Column:
    """``struct<region, html>`` of the first element with role main that has an end tag.

    The page is cut behind every ``>``.  Opening tags with the role and end tags are sorted
    by name, the last ones first: an opening tag that comes after an end tag in this order
    is closed.  Every tag is looked at once, however many are open.
    """
    tag = "struct<name:string,back:int,closing:boolean,choice:int>"

    def tags(part: Column, i: Column) -> Column:
        def noted(name: Column, closing: bool, choice: Column) -> Column:
            return F.struct(
                F.lower(name).alias("name"), (-i).alias("back"), F.lit(closing).alias("closing"), choice.alias("choice")
            )

        # A tag may have begun several times before its role; the first that is closed counts.
        names = F.regexp_extract_all(F.regexp_extract(part, _BEFORE_ROLE, 1), F.lit(_OPENING), F.lit(1))
        opened = F.when(
            F.rlike(part, F.lit(_HAS_ROLE)) & F.endswith(part, F.lit(">")),
            F.transform(names, lambda name, n: noted(name, False, n)),
        ).otherwise(F.array().cast(f"array<{tag}>"))
        closed = F.filter(F.array(F.regexp_extract(part, _CLOSING, 1)), lambda name: name != "")
        return F.concat(opened, F.transform(closed, lambda name: noted(name, True, F.lit(0))))

    def chosen(sorted_tags: Column) -> Column:
        """Place and name of the first opening tag that is closed, NULL if there is none."""
        none = F.lit(None).cast("struct<at:int,choice:int,name:string>")

        def step(state: Column, one: Column) -> Column:
            closed = (state["name"] == one["name"]) & state.closed
            this = F.struct((-one.back).alias("at"), one.choice.alias("choice"), one["name"].alias("name"))
            return F.struct(
                one["name"].alias("name"),
                (one.closing | closed).alias("closed"),
                F.when(~one.closing & closed, F.least(state.best, this)).otherwise(state.best).alias("best"),
            )

        start = F.struct(F.lit("").alias("name"), F.lit(False).alias("closed"), none.alias("best"))
        return F.aggregate(sorted_tags, start, step).best

    def inside(parts: Column, found: Column, best: Column) -> Column:
        ends = F.filter(found, lambda one: one.closing & (one["name"] == best["name"]) & (-one.back > best.at))
        end = F.array_min(F.transform(ends, lambda one: -one.back))
        last = F.regexp_replace(F.get(parts, end), r"</[^<>]*>\z", "")
        return F.concat(F.array_join(F.slice(parts, best.at + 2, end - best.at - 1), ""), last)

    def search(parts: Column) -> Column:
        return let(
            F.flatten(F.transform(parts, tags)),
            lambda found: let(
                chosen(F.array_sort(found)),
                lambda best: F.when(
                    best.isNotNull(),
                    F.struct(F.lit("role").alias("region"), inside(parts, found, best).alias("html")),
                ),
            ),
        )

    return F.when(F.rlike(html, F.lit(_HAS_ROLE)), let(F.split(html, "(?<=>)"), search))


@by_name
def main_content(cleaned: Column) -> Column:
    """``struct<region, html>``: main, article, role=main, body or all of a cleaned page."""
    return let(
        cleaned,
        lambda html: F.coalesce(
            _inside(disarm(html, "main"), "main", element("main"), 1),
            _inside(disarm(html, "article"), "article", element("article"), 1),
            _inside_role_main(html),
            _inside(disarm(html, "body"), "body", element("body"), 1),
            F.struct(F.lit("whole").alias("region"), html.alias("html")),
        ),
    )


@by_name
def clean_page(html: Column) -> Column:
    return remove_non_content(scrub(html))


@by_name
def page_content(html: Column) -> Column:
    """``struct<region, html>`` with everything removed that is not rendered."""
    return let(
        main_content(clean_page(html)),
        lambda content: F.struct(
            content.region.alias("region"), strip_boilerplate(content.html).alias("html")
        ),
    )


def content_profile(pages: DataFrame) -> DataFrame:
    """Per host and winning region: how much of the HTML is content."""
    measured = pages.select(
        url_host(page_url("url")).alias("host"),
        F.length("html").cast("bigint").alias("raw"),
        page_content("html").alias("content"),
    ).select("host", "content.region", "raw", F.length("content.html").cast("bigint").alias("kept"))
    return (
        measured.groupBy("host", "region")
        .agg(
            F.count("*").alias("pages"),
            F.sum("raw").alias("raw_chars"),
            F.sum("kept").alias("content_chars"),
        )
        .withColumn(
            "removed_share",
            F.try_divide((F.col("raw_chars") - F.col("content_chars")).cast("double"), F.col("raw_chars").cast("double")),
        )
    )
