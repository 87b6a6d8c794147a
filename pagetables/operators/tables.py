"""HTML tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cache import once
from ..functions.exprs import let, matches
from ..functions.text import NOT_WORD_AHEAD, disarm, element, inline_text, rearm
from .content import page_content

TABLE = element("table")
_CELL = rf"(?is)<(th|td){NOT_WORD_AHEAD}[^>]*>(.*?)</\1>"


def table_rows(table: Column) -> Column:
    """``array<array<string>>`` of one table, padded to its widest row."""

    def cells(row: Column) -> Column:
        found = matches(disarm(row, "th", "td"), _CELL, "$2")
        return F.transform(found, lambda cell: inline_text(rearm(cell)))

    rows = matches(disarm(table, "tr"), element("tr"), "$1")
    filled = F.filter(F.transform(rows, cells), lambda row: F.size(row) > 0)

    def pad(rows: Column) -> Column:
        width = F.array_max(F.transform(rows, F.size))
        return F.transform(
            rows, lambda row: F.concat(row, F.array_repeat(F.lit(""), (width - F.size(row)).cast("int")))
        )

    return let(filled, pad)


@once
def _tables() -> Column:
    """Tables with at least one row."""
    found = matches(F.col("_content"), TABLE, "$1")
    return F.filter(F.transform(found, lambda t: table_rows(rearm(t))), lambda rows: F.size(rows) > 0)


def html_tables(pages: DataFrame) -> DataFrame:
    """One row per table row of the main content; row 0 is the header."""
    content = pages.select("page_id", page_content("html").html.alias("_content"))
    content = content.withColumn("_content", disarm(F.col("_content"), "table"))
    return content.select("page_id", F.posexplode(_tables()).alias("table_no", "rows")).select(
        "page_id", "table_no", F.posexplode("rows").alias("row_no", "cells")
    )
