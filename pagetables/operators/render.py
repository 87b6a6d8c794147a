"""HTML to Markdown as a chain of projections.

The text under construction and its first error are two columns; labels of block
anchors go through the same steps as an array column.
"""

from __future__ import annotations

from collections.abc import Callable
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cache import once
from ..functions.exprs import (
    SEP,
    after_sep,
    before_sep,
    error,
    first_error,
    let,
    pieces,
    rewrite,
    settle,
    up_to_last,
)
from ..functions.text import (
    NOT_WORD_AHEAD,
    SPACE,
    attribute,
    disarm,
    element,
    inline_text,
    normalize_markdown,
    rearm,
    squeeze_blank_lines,
    strip_tags,
    trim_space,
)
from ..functions.urls import resolve_urls, url_text
from .content import main_content, strip_boilerplate
from .metadata import INVALID_URL, with_metadata
from .tables import table_rows

_ANCHOR = rf"(?is)<a{NOT_WORD_AHEAD}([^>]*)>(.*?)</a>"
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_HEADING = rf"(?is)<h([1-6]){NOT_WORD_AHEAD}[^>]*>(.*?)</h\1>"

# Tags that make an anchor a block, words that start a call to
# action and its longest length, the label of an anchor without one, and tags that
# end or start a line.
_BLOCK_TAGS = "h[1-6]|p|div|section|article|main|ul|ol|li|table"
_ACTION_WORDS = "Explore|Learn|Read|View|Open|Start|Try|Sign up|Get started"
_ACTION_LENGTH = 80
_DEFAULT_LABEL = "Open page"
_CLOSING_BLOCKS = "div|section|article|main|ul|ol|tr"
_OPENING_BLOCKS = "div|section|article|main|ul|ol|tbody|thead|tr"

_IS_BLOCK = rf"(?i)<(?:{_BLOCK_TAGS}){NOT_WORD_AHEAD}"
_IS_ACTION = rf"(?i)\A(?:{_ACTION_WORDS}){NOT_WORD_AHEAD}"


def table_markdown(table: Column) -> Column:
    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def write(rows: Column) -> Column:
        ruler = F.transform(rows[0], lambda _cell: F.lit("---"))
        lines = F.concat(
            F.slice(rows, 1, 1), F.array(ruler), F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
        )
        return F.concat(F.lit("\n"), F.array_join(F.transform(lines, line), "\n"), F.lit("\n\n"))

    return let(table_rows(table), lambda rows: F.when(F.size(rows) == 0, "\n").otherwise(write(rows)))


def _bare_line(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, rf"\A#+[{SPACE}]*", ""), rf"\A-[{SPACE}]*", "")


def _link(label: Column, url: Column) -> Column:
    return F.concat(F.lit("["), label, F.lit("]("), url, F.lit(")"))


def _heading(piece: Column) -> Column:
    level = F.substring(piece, 1, 1).cast("int")
    return F.concat(
        F.lit("\n"),
        F.repeat(F.lit("#"), level),
        F.lit(" "),
        inline_text(F.substr(piece, F.lit(2))),
        F.lit("\n\n"),
    )


def _lines_around(before: str, after: str) -> Callable[[Column], Column]:
    return lambda text: F.concat(F.lit(before), inline_text(text), F.lit(after))


def _break_lines(text: Column) -> Column:
    text = F.regexp_replace(text, rf"(?i)<br[{SPACE}]*/?>", "\n")
    text = F.regexp_replace(text, f"(?i)</(?:{_CLOSING_BLOCKS})>", "\n")
    opening = f"(?i)<(?:{_OPENING_BLOCKS}){NOT_WORD_AHEAD}[^>]*>"
    return up_to_last(text, ">", lambda head: F.regexp_replace(head, opening, "\n"))


def _rewrite_elements(text: Column, tag: str, fn: Callable[[Column], Column]) -> Column:
    return rearm(rewrite(disarm(text, tag), element(tag), "$1", fn))


# The rewriting steps around the anchors, in order.
_BEFORE_ANCHORS: tuple[Callable[[Column], Column], ...] = (
    lambda text: _rewrite_elements(strip_boilerplate(text), "table", table_markdown),
)
_AFTER_ANCHORS: tuple[Callable[[Column], Column], ...] = (
    lambda text: rearm(rewrite(disarm(text, *_HEADINGS), _HEADING, "$1$2", _heading)),
    lambda text: _rewrite_elements(text, "li", _lines_around("\n- ", "\n")),
    lambda text: _rewrite_elements(text, "p", _lines_around("\n", "\n\n")),
    lambda text: normalize_markdown(strip_tags(_break_lines(text))),
)


@once
def _text_step(step: Callable[[Column], Column]) -> Column:
    return step(F.col("_text"))


@once
def _label_step(step: Callable[[Column], Column]) -> Column:
    """A step over the labels of block anchors.  The error of a text is taken before
    the next step, which may drop it."""
    return F.transform(
        F.col("_labels"),
        lambda label: F.struct(
            step(label.text).alias("text"),
            F.coalesce(label.error, first_error(label.text)).alias("error"),
        ),
    )


def _advance(pages: DataFrame, text: Column) -> DataFrame:
    """Next text, and the first error of the present one."""
    return pages.withColumns(
        {"_text": text, "_error": F.coalesce(F.col("_error"), first_error(F.col("_text")))}
    )


@once
def _read_anchors() -> Column:
    def read(piece: Column) -> Column:
        return let(
            F.struct(rearm(before_sep(piece)).alias("attrs"), rearm(after_sep(piece)).alias("label")),
            lambda a: F.struct(
                a.attrs.alias("attrs"),
                a.label.alias("label"),
                F.nullif(attribute(a.attrs, "href"), F.lit("")).alias("href"),
                F.rlike(a.label, F.lit(_IS_BLOCK)).alias("block"),
            ),
        )

    return F.transform(F.filter(F.col("_pieces"), lambda piece, i: i % 2 == 1), read)


@once
def _label_texts() -> Column:
    """Labels to render: those of block anchors."""
    return F.transform(
        F.col("_anchors"),
        lambda a: F.struct(
            F.when(a.block, a.label).alias("text"), F.lit(None).cast("string").alias("error")
        ),
    )


@once
def _choose_labels() -> Column:
    """Link label of every block anchor: its last call-to-action line, else the
    accessible name, else a fixed text."""

    def choose(rendered: Column, attrs: Column) -> Column:
        lines = F.transform(F.split(rendered.text, "\n"), lambda line: trim_space(_bare_line(line)))
        actions = F.filter(
            lines, lambda line: (F.length(line) <= _ACTION_LENGTH) & F.rlike(line, F.lit(_IS_ACTION))
        )
        named = inline_text(F.coalesce(attribute(attrs, "aria-label"), F.lit(_DEFAULT_LABEL)))
        return let(
            F.coalesce(F.try_element_at(actions, F.lit(-1)), named),
            lambda label: F.struct(
                rendered.text.alias("text"),
                label.alias("label"),
                inline_text(label).alias("target"),
                F.coalesce(rendered.error, first_error(rendered.text), first_error(label)).alias("error"),
            ),
        )

    return F.zip_with(
        F.col("_labels"), F.col("_anchors"), lambda rendered, a: F.when(a.block, choose(rendered, a.attrs))
    )


@once
def _write_anchors() -> Column:
    """Markdown of every anchor."""

    def inline(anchor: Column, url: Column) -> Column:
        return let(
            inline_text(anchor.label),
            lambda text: F.when(anchor.href.isNull() | (text == ""), text).otherwise(_link(text, url)),
        )

    def block(anchor: Column, url: Column, chosen: Column) -> Column:
        # The content without the line that became the link's label.
        body = F.filter(
            F.split(chosen.text, "\n"), lambda line: inline_text(_bare_line(line)) != chosen.target
        )
        return F.concat(
            F.coalesce(error(chosen.error), F.lit("")),
            F.lit("\n"),
            squeeze_blank_lines(F.array_join(body, "\n")),
            F.when(anchor.href.isNull(), "").otherwise(F.concat(F.lit("\n\n"), _link(chosen.label, url))),
            F.lit("\n"),
        )

    def write(zipped: Column) -> Column:
        anchor = zipped["_anchors"]
        url = F.coalesce(url_text(zipped["_urls"]), error(F.lit(INVALID_URL)))
        return F.when(anchor.block, block(anchor, url, zipped["_labels"])).otherwise(inline(anchor, url))

    # Zipped and not looked up by place: a column used once inside a lambda may be
    # computed anew for every element.
    return F.transform(F.arrays_zip("_anchors", "_urls", "_labels"), write)


def _with_anchors(pages: DataFrame) -> DataFrame:
    """Replace the anchors of ``_text``; links resolve against ``canonical``.

    A label cannot hold another complete anchor, so labels need no anchor step.
    """
    listed = (
        pages.withColumn("_text", disarm(F.col("_text"), "a"))
        .withColumn("_head", F.regexp_extract("_text", r"(?is)\A.*</a>", 0))
        .withColumns(
            {
                "_pieces": pieces(F.col("_head"), _ANCHOR, f"$1{SEP}$2"),
                "_tail": F.substr("_text", F.length("_head") + 1),
            }
        )
        .withColumn("_anchors", _read_anchors())
        .withColumns(
            {"_hrefs": F.transform("_anchors", lambda a: a.href), "_labels": _label_texts()}
        )
        .withColumn("_urls", resolve_urls("_hrefs", "canonical"))
    )
    for step in _BEFORE_ANCHORS + _AFTER_ANCHORS:
        listed = listed.withColumn("_labels", _label_step(step))
    written = listed.withColumn("_labels", _choose_labels()).withColumn("_written", _write_anchors())
    between = F.filter("_pieces", lambda piece, i: i % 2 == 0)
    text = F.zip_with(between, "_written", lambda before, anchor: F.concat(before, F.coalesce(anchor, F.lit(""))))
    return _advance(written, rearm(F.concat(F.array_join(text, ""), F.col("_tail")))).drop(
        "_head", "_tail", "_pieces", "_anchors", "_hrefs", "_urls", "_labels", "_written"
    )


def with_markdown(prepared: DataFrame) -> DataFrame:
    """Add ``body`` and ``body_error`` to the output of `with_metadata`.

    One projection per step: a step reads the text of the one before, so nothing is
    computed twice and the plan grows linearly.
    """
    pages = prepared.withColumns(
        {"_text": main_content("cleaned")["html"], "_error": F.lit(None).cast("string")}
    )
    for step in _BEFORE_ANCHORS:
        pages = _advance(pages, _text_step(step))
    pages = _with_anchors(pages)
    for step in _AFTER_ANCHORS:
        pages = _advance(pages, _text_step(step))
    return pages.withColumns(
        {"body": F.col("_text"), "body_error": F.coalesce(F.col("_error"), first_error(F.col("_text")))}
    ).drop("_text", "_error")


def render_markdown(pages: DataFrame) -> DataFrame:
    """Markdown of the main content of every page."""
    rendered = with_markdown(with_metadata(pages.select("page_id", "url", "html")))
    failed = F.coalesce(F.when(F.col("canonical").isNull(), INVALID_URL), F.col("body_error"))
    return settle(
        rendered, "page_id", F.when(failed.isNull(), F.col("body")).alias("markdown"), failed.alias("error")
    )
