"""Documents and crawl records."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cache import by_name
from ..functions.exprs import first_error, let, settle
from ..functions.text import trim_end, trim_space
from ..functions.urls import page_url, url_text
from .metadata import with_metadata
from .render import with_markdown
from .structured import with_sections

# Reasons of failed pages; fixed values: phrases of the document.
EMPTY_HTML = "empty-html"
UNSUPPORTED_TYPE = "unsupported-content-type"
_NO_DESCRIPTION = "No description found."
_NO_CONTENT = "No extractable content found."

_NOT_A_PARAGRAPH = r"\A(?:#|- |\||\z)"


def iso_time(time: Column) -> Column:
    """UTC text with milliseconds, whatever the session's zone."""
    return F.date_format(
        F.convert_timezone(F.current_timezone(), F.lit("UTC"), time.cast("timestamp").cast("timestamp_ntz")),
        "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'",
    )


def _time(value: datetime | str | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


@by_name
def first_paragraph(markdown: Column) -> Column:
    """First line that is text: no heading, list item or table row."""
    lines = F.transform(F.split(markdown, "\n"), trim_space)
    return F.coalesce(
        F.get(F.filter(lines, lambda line: ~F.rlike(line, F.lit(_NOT_A_PARAGRAPH))), 0), F.lit("")
    )


def with_document(pages: DataFrame, generated_at: Column) -> DataFrame:
    """Add ``document`` and ``document_error`` to a table with ``url`` and ``html``."""
    described = with_markdown(with_sections(with_metadata(pages))).withColumn(
        "description",
        let(
            F.col("meta_description"),
            lambda text: F.when(text != "", text).otherwise(first_paragraph("body")),
        ),
    )

    def or_else(text: Column, phrase: str) -> Column:
        return F.coalesce(F.nullif(text, F.lit("")), F.lit(phrase))

    document = F.concat_ws(
        "\n",
        F.concat(F.lit("# "), F.col("title")),
        F.lit(""),
        F.concat(F.lit("Canonical URL: "), url_text(F.col("canonical"), query=False)),
        F.concat(F.lit("Last generated: "), iso_time(generated_at)),
        F.lit("Source: public HTML"),
        F.lit(""),
        F.lit("## Description"),
        or_else(F.col("description"), _NO_DESCRIPTION),
        F.when(F.col("structured") != "", F.concat(F.lit("\n## Structured Data\n"), F.col("structured"))),
        F.lit(""),
        F.lit("## Content"),
        or_else(F.col("body"), _NO_CONTENT),
    )
    failure = F.coalesce(
        F.when(F.coalesce(F.col("html"), F.lit("")) == "", EMPTY_HTML),
        F.col("metadata_error"),
        first_error(F.col("structured")),
        F.col("body_error"),
    )
    return described.withColumn("document_error", failure).withColumn(
        "document", F.when(F.col("document_error").isNull(), F.concat(trim_end(document), F.lit("\n")))
    )


def build_documents(pages: DataFrame, generated_at: datetime | str | Column) -> DataFrame:
    """One Markdown document per page, or the reason why there is none."""
    built = with_document(pages.select("page_id", "url", "html"), _time(generated_at))
    good = F.col("document_error").isNull()
    return settle(
        built,
        "page_id",
        F.when(good, url_text(F.col("canonical"), query=False)).alias("canonical_url"),
        F.when(good, F.col("title")).alias("title"),
        F.when(good, F.col("description")).alias("description"),
        F.col("document").alias("markdown"),
        F.col("document_error").alias("error"),
    )


def fetch_failure(responses: DataFrame) -> Column:
    """Why a response is not extracted, NULL if it is."""
    content_type = F.lower(F.coalesce("content_type", F.lit("")))
    return (
        F.when(F.col("fetch_error").isNotNull(), F.col("fetch_error"))
        .when(
            ~F.coalesce(F.col("http_status").between(200, 299), F.lit(False)),
            F.concat(F.lit("http-"), F.coalesce(F.col("http_status").cast("string"), F.lit("0"))),
        )
        .when(~F.contains(content_type, F.lit("text/html")), UNSUPPORTED_TYPE)
    )


def crawl_pages(responses: DataFrame, generated_at: datetime | str | Column) -> DataFrame:
    """`ready` or `failed` resource row per response.  See `dead_letters` for the rest.

    ``seq`` orders the writes of one time: it is taken from the responses, or is the
    time of the fetch.
    """
    order = [name for name in ("seq", "fetched_at") if name in responses.columns][:1]
    kept = ["seq"] if order else []
    gated = responses.select(
        *[F.col(name).alias("seq") for name in order],
        _time(generated_at).alias("generated_at"),
        page_url("url").alias("record_url"),
        "url",
        fetch_failure(responses).alias("fetch_failure"),
        "html",
    ).filter(F.col("record_url").isNotNull())
    # Only good responses are worth the extraction.
    readable = gated.withColumn("html", F.when(F.col("fetch_failure").isNull(), F.coalesce("html", F.lit(""))))
    built = with_document(readable, F.col("generated_at"))
    reason = F.coalesce(F.col("fetch_failure"), F.col("document_error"))
    return settle(
        built,
        *kept,
        F.concat(F.lit("page:"), F.col("record_url")).alias("key"),
        F.col("record_url").alias("url"),
        F.when(reason.isNull(), "ready").otherwise("failed").alias("status"),
        "generated_at",
        F.when(reason.isNull(), F.col("document")).alias("markdown"),
        reason.alias("reason"),
    )


def dead_letters(responses: DataFrame) -> DataFrame:
    """Responses whose own URL is invalid, so that they have no key."""
    return responses.filter(page_url("url").isNull()).drop("html")
