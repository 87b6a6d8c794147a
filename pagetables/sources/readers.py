"""Readers with fixed schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import schemas
from ..operators.sitemap import fetched_sitemaps
from ..operators.store import parse_resource_json
from ..operators.traffic import normalize_requests
from .buckets import attach, declared


def _read(
    spark: SparkSession, path: str, schema: T.StructType, file_format: str, streaming: bool
) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).format(file_format).load(path)


def read_responses(
    spark: SparkSession, path: str, streaming: bool = False, file_format: str = "parquet"
) -> DataFrame:
    """Fetched pages."""
    return _read(spark, path, schemas.RESPONSES, file_format, streaming)


def read_requests(
    spark: SparkSession,
    path: str,
    origin: str | None = None,
    streaming: bool = False,
    file_format: str = "parquet",
) -> DataFrame:
    """Request rows from server logs: raw paths resolve against ``origin``."""
    return normalize_requests(_read(spark, path, schemas.HTTP_LOG, file_format, streaming), origin)


def read_sitemaps(
    spark: SparkSession, path: str, streaming: bool = False, file_format: str = "parquet"
) -> DataFrame:
    """Fetched sitemaps.  `failed_sitemaps` of the raw table gives the others."""
    return fetched_sitemaps(_read(spark, path, schemas.SITEMAPS, file_format, streaming))


def read_crawl_messages(
    spark: SparkSession, path: str, streaming: bool = True, file_format: str = "json"
) -> DataFrame:
    return _read(spark, path, schemas.CRAWL_MESSAGES, file_format, streaming)


#: Later writes win; inside one batch the later time, then the later in order.
_WRITE_ORDER = ("written_at", "batch_id", "generated_at", "seq", "writer", "row")


def _resource_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.table(declared(spark, path, schemas.RESOURCE_LOG, schemas.BATCHES))


def _last_writes(log: DataFrame, *facts: str) -> DataFrame:
    """Place of the current row of each key, with some narrow columns of it."""
    order = F.struct(*_WRITE_ORDER)
    return log.groupBy("key").agg(F.max_by(F.struct("place", *facts), order).alias("of"), F.max(order).alias("_last"))


def read_resources(spark: SparkSession, path: str) -> DataFrame:
    """Current record per key of a table made by `write_resources`.

    The current rows are chosen without the Markdown, which is then read in place: it is
    neither sorted nor shuffled.
    """
    log = _resource_log(spark, path)
    last = _last_writes(log).select(F.col("of.place").alias("_place"), "_last")
    return attach(last, log, F.struct(*_WRITE_ORDER) >= F.col("_last")).select(*schemas.RESOURCES.fieldNames())


def read_record_facts(spark: SparkSession, path: str) -> DataFrame:
    """What routing needs of the current records: of the Markdown its length and whether
    it is blank, which were kept when it was written.  No Markdown is read."""
    facts = ("url", "status", "generated_at", "markdown_blank", "markdown_length")
    return _last_writes(_resource_log(spark, path), *facts).select("key", *[f"of.{name}" for name in facts])


def read_response_store(spark: SparkSession, path: str) -> DataFrame:
    """Landed responses of a store made by `write_responses`, with their resource ``key``."""
    return spark.table(declared(spark, path, schemas.RESPONSE_STORE, schemas.BATCHES))


def read_resource_json(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Records landed as key and JSON text."""
    return parse_resource_json(_read(spark, path, schemas.STORED_JSON, file_format, streaming=False))
