"""Sitemaps to URL lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import work_folder
from ..functions.exprs import matches, scrub
from ..functions.text import decode_xml, disarm, rearm, trim_space
from ..functions.values import number_of_text

_LOCATION = "(?is)<loc>(.*?)</loc>"


def sitemap_locations(xml: Column) -> Column:
    """Array of page URLs in document order.  Broken XML still gives its URLs."""
    decoded = F.transform(
        matches(disarm(scrub(xml), "loc"), _LOCATION, "$1"),
        lambda location: decode_xml(trim_space(rearm(location))),
    )
    return F.filter(decoded, lambda url: url != "")


def fetched_sitemaps(sitemaps: DataFrame) -> DataFrame:
    """Sitemaps fetched with a 2xx status."""
    return sitemaps.filter(F.col("http_status").between(200, 299))


def failed_sitemaps(sitemaps: DataFrame) -> DataFrame:
    """Sitemaps to report: the other part of `fetched_sitemaps`."""
    return sitemaps.filter(~F.coalesce(F.col("http_status").between(200, 299), F.lit(False)))


def _plain_columns(sitemaps: DataFrame) -> DataFrame:
    return sitemaps.drop("http_status", "fetched_at")


def _explode(sitemaps: DataFrame, locations: Column) -> DataFrame:
    kept = [name for name in _plain_columns(sitemaps).columns if name != "xml"]
    return sitemaps.select(*kept, F.posexplode(locations).alias("pos", "url"))


def sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """One row per URL with its position; the XML is dropped at once."""
    return _explode(sitemaps, sitemap_locations(F.col("xml")))


def crawl_frontier(sitemaps: DataFrame, max_pages: int | float | str | None = None) -> DataFrame:
    """First ``max_pages`` URLs of every sitemap, all of them by default.  Duplicates count."""
    if max_pages is None:
        return sitemap_urls(sitemaps)
    limit = _page_limit(max_pages)
    return _explode(sitemaps, F.slice(sitemap_locations(F.col("xml")), 1, limit))


def crawl_run_frontier(sitemaps: DataFrame, max_pages: int | float | str, *order: str) -> DataFrame:
    """First ``max_pages`` URLs of all sitemaps of a run together, in the sitemaps' ``order``.

    URLs are counted per sitemap, the counts summed per range of sitemaps, and these sums
    summed over the ranges: a window spans the ranges or the sitemaps of one range, never
    the URLs of a run.  Sitemaps beyond the limit are not opened again.
    """
    limit = _page_limit(max_pages)
    by = order or tuple(name for name in ("sitemap_url", "sitemap_id") if name in sitemaps.columns)
    spark = sitemaps.sparkSession

    def kept(frame: DataFrame, purpose: str) -> DataFrame:
        path = work_folder(spark, purpose)
        frame.write.parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    opened = kept(
        _plain_columns(sitemaps)
        .withColumn("_urls", F.slice(sitemap_locations(F.col("xml")), 1, limit))
        .withColumn("_row", F.monotonically_increasing_id())
        .drop("xml"),
        "sitemaps",
    )
    ranged = opened.select(*by, "_row", F.size("_urls").cast("bigint").alias("_n")).repartitionByRange(*by, "_row")
    ranged = kept(ranged.withColumn("_range", F.spark_partition_id()), "sitemap-ranges")
    totals = ranged.groupBy("_range").agg(F.sum("_n").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = totals.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(*by, "_row").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(starts, "_range")
        .select("_row", (F.col("_start") + F.col("_inside")).alias("_offset"))
        .filter(F.col("_offset") < limit)
    )
    rows = opened.join(offsets, "_row")
    taken = rows.withColumn("_urls", F.slice("_urls", F.lit(1), (F.lit(limit) - F.col("_offset")).cast("int")))
    named = [name for name in opened.columns if not name.startswith("_")]
    return taken.select(*named, F.posexplode("_urls").alias("pos", "url"))


def _page_limit(max_pages: int | float | str) -> int:
    """A limit as a whole number; text that is no number takes nothing."""
    limit = number_of_text(max_pages) if isinstance(max_pages, str) else float(max_pages)
    if limit != limit:
        return 0
    if limit < 0:
        raise ValueError("max_pages must not be negative")
    return int(min(limit, 2**31 - 1))
