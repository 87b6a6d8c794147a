"""Title, canonical URL and description of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cache import by_name
from ..functions.exprs import first_error, let, matches, rewrite, settle
from ..functions.text import NOT_WORD_AHEAD, NOT_WORD_BEHIND, SPACE, attribute, disarm, element, inline_text, rearm
from ..functions.urls import parse_url, url_text
from .content import clean_page

INVALID_URL = "Invalid URL"

_LINK = rf"(?i)<link{NOT_WORD_AHEAD}([^>]*)>"
_META = rf"(?i)<meta{NOT_WORD_AHEAD}([^>]*)>"
_CANONICAL_WORD = rf"(?:\A|[{SPACE}])canonical(?:[{SPACE}]|\z)"


def _tags(html: Column, pattern: str) -> Column:
    """Attributes of all complete tags; nothing behind the last ``>`` is one."""
    return matches(F.regexp_extract(html, r"(?s)\A.*>", 0), pattern, "$1")


@by_name
def canonical_href(cleaned: Column) -> Column:
    """href of the first canonical link, NULL if there is none."""
    links = F.filter(
        _tags(cleaned, _LINK),
        lambda attrs: F.rlike(F.lower(F.coalesce(attribute(attrs, "rel"), F.lit(""))), F.lit(_CANONICAL_WORD)),
    )
    return let(F.get(links, 0), lambda attrs: attribute(attrs, "href"))


@by_name
def title_text(cleaned: Column) -> Column:
    return inline_text(rearm(F.regexp_extract(disarm(cleaned, "title"), element("title"), 1)))


@by_name
def meta_description(cleaned: Column) -> Column:
    """Content of the first description tag, even if it is empty."""
    tags = F.filter(
        _tags(cleaned, _META),
        lambda attrs: F.coalesce(F.lower(attribute(attrs, "name")) == "description", F.lit(False)),
    )
    return let(F.get(tags, 0), lambda attrs: inline_text(F.coalesce(attribute(attrs, "content"), F.lit(""))))


@by_name
def title_from_url(url: Column) -> Column:
    """Last path segment with word starts in upper case, else the host."""
    segments = F.filter(F.split(url.path, "/"), lambda segment: segment != "")

    def capitalize(segment: Column) -> Column:
        spaced = F.regexp_replace(segment, "[-_]+", " ")
        return rewrite(spaced, f"{NOT_WORD_BEHIND}([a-z])", "$1", F.upper)

    return F.coalesce(let(F.try_element_at(segments, F.lit(-1)), capitalize), url.host)


def with_metadata(pages: DataFrame) -> DataFrame:
    """Add cleaned HTML, parsed canonical URL, title, description and first error."""
    described = (
        pages.withColumn("cleaned", clean_page("html"))
        .withColumns(
            {
                "canonical_href": F.coalesce(canonical_href("cleaned"), F.col("url")),
                "page_title": title_text("cleaned"),
                "meta_description": F.coalesce(meta_description("cleaned"), F.lit("")),
            }
        )
        .withColumn("canonical", parse_url("canonical_href"))
    )
    return described.withColumns(
        {
            "metadata_error": F.coalesce(
                F.when(F.col("canonical").isNull(), INVALID_URL),
                first_error(F.col("page_title")),
                first_error(F.col("meta_description")),
            ),
            "title": F.when(F.col("page_title") != "", F.col("page_title")).otherwise(
                title_from_url("canonical")
            ),
        }
    )


def page_metadata(pages: DataFrame) -> DataFrame:
    """One row per page; ``error`` says why a page has no metadata."""
    prepared = with_metadata(pages.select("page_id", "url", "html"))
    good = F.col("metadata_error").isNull()
    return settle(
        prepared,
        "page_id",
        F.when(good, url_text(F.col("canonical"), query=False)).alias("canonical_url"),
        F.when(good, F.col("title")).alias("title"),
        F.when(good, F.col("meta_description")).alias("meta_description"),
        F.col("metadata_error").alias("error"),
    )
