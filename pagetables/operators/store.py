"""The keyed table of page resources."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import let
from ..functions.text import is_blank
from ..functions.urls import resource_key, url_host
from ..functions.values import date_of, number_of
from .documents import iso_time

PAGE_PREFIX = "page:"


def latest_resources(records: DataFrame, *order: str) -> DataFrame:
    """Last write per key, whatever its status.

    ``order`` names the columns that order writes, by default time and, if there is
    one, ``seq``.  `max_by` combines before the shuffle, so a hot key costs one row
    per task.
    """
    by = order or tuple(name for name in ("generated_at", "seq") if name in records.columns)
    fields = [name for name in records.columns if name != "key"]
    return (
        records.groupBy("key")
        .agg(F.max_by(F.struct(*fields), F.struct(*by)).alias("last"))
        .select("key", *[F.col("last")[name].alias(name) for name in fields])
    )


def _hours(window_hours: float | int | str | Column) -> Column:
    """Hours as a finite number, else NULL; blank text is zero."""
    window = window_hours if isinstance(window_hours, Column) else F.lit(window_hours)
    return let(number_of(window.cast("string")), lambda number: F.when(F.abs(number) < float("inf"), number))


def instant(rows: DataFrame, name: str) -> Column:
    """A column of times, also where they are written as text."""
    return (date_of(F.col(name)) if dict(rows.dtypes)[name] == "string" else F.col(name).cast("timestamp")).alias(name)


def is_servable(
    status: Column,
    generated_at: Column,
    markdown_blank: Column,
    as_of: Column,
    window_hours: float | int | str | Column,
) -> Column:
    """Whether a record's Markdown may be served at ``as_of``.  The window's end counts."""
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(generated_at.try_cast("timestamp"))
    # Ages compare in whole milliseconds.
    fresh = F.floor(age / 1000) <= _hours(window_hours) * 3_600_000
    return F.coalesce(
        ~markdown_blank & ((status == "ready") | ((status == "stale") & fresh)), F.lit(False)
    )


def markdown_is_blank(markdown: Column) -> Column:
    return F.coalesce(is_blank(markdown), F.lit(True))


def servable_resources(
    resources: DataFrame, as_of: datetime | str | Column, window_hours: float | int | str = 168
) -> DataFrame:
    time = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return resources.filter(
        is_servable(
            F.col("status"),
            instant(resources, "generated_at"),
            markdown_is_blank(F.col("markdown")),
            time,
            window_hours,
        )
    )


def clear_resources(resources: DataFrame, prefix: str = PAGE_PREFIX, confirm: bool = False) -> DataFrame:
    """Everything but the records whose key starts with ``prefix``."""
    if not confirm:
        raise ValueError("refusing to clear resources without confirm=True")
    return resources.filter(~F.startswith("key", F.lit(prefix or PAGE_PREFIX)))


def _target_key() -> Column:
    return F.when(F.startswith("target", F.lit(PAGE_PREFIX)), F.col("target")).otherwise(resource_key("target"))


def drop_resources(resources: DataFrame, targets: DataFrame) -> DataFrame:
    """Everything but the records named by ``targets.target``: URLs or keys.

    `invalid_targets` has those that are neither.
    """
    return resources.join(targets.select(_target_key().alias("key")).distinct(), "key", "left_anti")


def invalid_targets(targets: DataFrame) -> DataFrame:
    """Targets that name no record, to report."""
    return targets.filter(_target_key().isNull())


def resource_json(records: DataFrame) -> Column:
    """JSON text of a record; a NULL field is left out, so each kind has its own."""
    return F.to_json(
        F.struct(
            "status",
            "url",
            iso_time(F.col("generated_at")).alias("generatedAt"),
            F.when(F.col("status") != "failed", F.col("markdown")).alias("markdown"),
            F.when(F.col("status") == "failed", F.col("reason")).alias("reason"),
        ),
        {"ignoreNullFields": "true"},
    )


def export_resource_json(records: DataFrame) -> DataFrame:
    return records.select("key", "status", resource_json(records).alias("value"))


def _json_object(text: str) -> Column:
    """The members of a JSON object, NULL for any other or broken text."""
    return F.try_variant_get(F.try_parse_json(F.col(text)), "$", "map<string,variant>")


def parse_resource_json(stored: DataFrame) -> DataFrame:
    """Records from stored JSON texts.  Anything but an object counts as missing, and so
    does a field that is not a string."""

    def field(name: str) -> Column:
        value = F.try_variant_get(F.col("record"), f"$.{name}", "variant")
        return F.when(F.startswith(F.to_json(value), F.lit('"')), F.try_variant_get(value, "$", "string"))

    opened = stored.filter(_json_object("value").isNotNull()).select("key", F.try_parse_json("value").alias("record"))
    return opened.select(
        "key",
        field("url").alias("url"),
        field("status").alias("status"),
        date_of(field("generatedAt")).alias("generated_at"),
        field("markdown").alias("markdown"),
        field("reason").alias("reason"),
    )


def broken_resource_json(stored: DataFrame) -> DataFrame:
    """Stored texts that `parse_resource_json` leaves out, to report."""
    return stored.filter(_json_object("value").isNull())


def crawl_status_report(records: DataFrame) -> DataFrame:
    """Records per host, status and reason."""
    return (
        records.withColumn("host", url_host(F.col("url")))
        .groupBy("host", "status", "reason")
        .agg(F.count("*").alias("records"))
    )


def resource_keys(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", resource_key("url").alias("key"))


def collapse_variants(pages: DataFrame) -> DataFrame:
    """One row per page key with its number of URL variants."""
    return (
        pages.select("url", resource_key("url").alias("key"))
        .groupBy("key")
        .agg(F.count("*").alias("variants"), F.min("url").alias("first_url"))
    )
