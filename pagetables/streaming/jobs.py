"""Continuous versions of the operators.

Every job takes a streaming DataFrame and returns the started query.  Sinks are
written per micro-batch under the batch's number, so a batch that runs again after a
failure replaces its own output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import work_folder
from ..functions.urls import resource_key
from ..operators.documents import crawl_pages, dead_letters
from ..operators.routing import agent_page_requests, route_requests
from ..operators.sitemap import crawl_frontier, failed_sitemaps, fetched_sitemaps
from ..operators.traffic import classify_traffic
from ..schemas import RESPONSES
from ..sources.buckets import SALTS, attach, places
from ..sources.writers import write_resources

_SALTS = 64
#: Reason of the record of a queued URL that has no response.
NOT_LANDED = "not-landed"
#: Keys of a queue that are few enough to be named in the filter of the responses.
_SHORT_QUEUE = 200

TableReader = Callable[[SparkSession], DataFrame]


def _start(
    stream: DataFrame,
    checkpoint: str,
    each_batch: Callable[[DataFrame, int], None],
    available_now: bool,
    output_mode: str = "append",
) -> StreamingQuery:
    writer = (
        stream.writeStream.outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
        .foreachBatch(each_batch)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_route(
    requests: DataFrame,
    resources: TableReader,
    path: str,
    checkpoint: str,
    as_of: datetime | str | Column | None = None,
    window_hours: float | int | str = 168,
    available_now: bool = True,
) -> StreamingQuery:
    """`route_requests` per micro-batch.  Records are read anew for every batch."""

    def route(batch: DataFrame, batch_id: int) -> None:
        time = F.current_timestamp() if as_of is None else as_of
        routed = route_requests(batch, resources(batch.sparkSession), time, window_hours)
        routed.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return _start(requests, checkpoint, route, available_now)


def stream_warmup_queue(
    requests: DataFrame,
    resources: TableReader,
    path: str,
    checkpoint: str,
    lateness: str = "1 hour",
    available_now: bool = True,
) -> StreamingQuery:
    """Missed pages, once per watermark interval.  State holds keys of that interval only.

    Repeats are first dropped per key and salt, so a hot page is spread over tasks and
    sends one row per salt to the second step.  Records are read anew for every batch.
    """
    wanted = (
        agent_page_requests(requests.withWatermark("ts", lateness))
        .filter(F.col("method") == "GET")
        .withColumn("salt", F.pmod(F.xxhash64("request_id", "ts"), F.lit(_SALTS)))
        .dropDuplicatesWithinWatermark(["key", "salt"])
        .dropDuplicatesWithinWatermark(["key"])
        .select("key", F.col("page").alias("url"), F.col("ts").alias("requested_at"))
    )

    def queue(batch: DataFrame, batch_id: int) -> None:
        missed = batch.join(resources(batch.sparkSession).select("key"), "key", "left_anti")
        missed.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return _start(wanted, checkpoint, queue, available_now)


def _writer(checkpoint: str) -> str:
    """Name under which a job writes records: its own, and the same after a restart."""
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def _write_crawled(
    found: DataFrame, time: datetime | str | Column, path: str, batch_id: int, checkpoint: str, dead: str | None
) -> None:
    """Records of the responses; with a folder ``dead``, those with an invalid URL there."""
    write_resources(crawl_pages(found, time), path, batch_id, _writer(checkpoint))
    if dead is not None:
        dead_letters(found).write.mode("overwrite").parquet(f"{dead}/batch_id={batch_id}")


def stream_crawl(
    responses: DataFrame,
    path: str,
    checkpoint: str,
    generated_at: datetime | str | Column | None = None,
    available_now: bool = True,
    dead: str | None = None,
) -> StreamingQuery:
    """Responses to records.  Later batches win."""

    def crawl(batch: DataFrame, batch_id: int) -> None:
        time = F.current_timestamp() if generated_at is None else generated_at
        _write_crawled(batch, time, path, batch_id, checkpoint, dead)

    return _start(responses, checkpoint, crawl, available_now)


def _found_and_missing(urls: DataFrame, responses: DataFrame) -> DataFrame:
    """The responses of the queued URLs by resource key, and a failed one for each URL that
    has none.  A URL that is not valid keeps its own text, so that it is reported.

    Only keys are moved.  In a store made by `write_responses` the HTML of the responses is
    read where it lies, and of a short queue only the buckets of its keys.  Other tables of
    responses are joined as Spark chooses.
    """
    key = F.coalesce(resource_key("url"), F.concat(F.lit("#"), "url"))
    wanted = urls.filter(F.col("url").isNotNull() & (F.col("url") != "")).select("url", key.alias("key"))
    spark, folder = urls.sparkSession, work_folder(urls.sparkSession, "queue")
    # The queue is read several times, and its URLs may come from sitemaps.
    wanted.groupBy("key").agg(F.min("url").alias("_url")).write.parquet(folder)
    wanted = spark.read.schema("key string, _url string").parquet(folder)
    stored = "place" in responses.columns
    keyed = responses if stored else responses.withColumn("key", key)
    short = [row["key"] for row in wanted.select("key").limit(_SHORT_QUEUE + 1).collect()] if stored else []
    if stored and len(short) <= _SHORT_QUEUE:
        keyed = keyed.filter(F.col("place").isin([f"{key}#{salt}" for key in short for salt in range(SALTS)]))
    missing = wanted.join(keyed.select("key"), "key", "left_anti").select(
        F.col("_url").alias("url"), F.lit(NOT_LANDED).alias("fetch_error")
    )
    if stored:
        at = wanted.select(F.explode(places(F.col("key"))).alias("_place"))
        found = attach(at, keyed).select(*RESPONSES.fieldNames())
    else:
        found = keyed.join(wanted.select("key"), "key", "left_semi").drop("key")
    return found.unionByName(missing, allowMissingColumns=True)


def stream_crawl_queue(
    messages: DataFrame,
    responses: TableReader,
    path: str,
    checkpoint: str,
    generated_at: datetime | str | Column | None = None,
    available_now: bool = True,
    dead: str | None = None,
) -> StreamingQuery:
    """Crawl messages to records.  Messages without a URL are acknowledged and dropped.

    A URL without a response gets a failed record.  The checkpoint is the
    acknowledgement: a batch that failed is delivered again.
    """

    def crawl(batch: DataFrame, batch_id: int) -> None:
        time = F.current_timestamp() if generated_at is None else generated_at
        found = _found_and_missing(batch.select("url"), responses(batch.sparkSession))
        _write_crawled(found, time, path, batch_id, checkpoint, dead)

    return _start(messages, checkpoint, crawl, available_now)


def scheduled_crawl(
    sitemaps: DataFrame,
    responses: TableReader,
    path: str,
    checkpoint: str,
    max_pages: int | float | str | None = None,
    generated_at: datetime | str | Column | None = None,
    queue: str | None = None,
    available_now: bool = True,
    dead: str | None = None,
    failed: str | None = None,
) -> StreamingQuery:
    """One scheduler tick: new sitemaps to crawl messages in ``queue`` if there is
    one, else to records.

    Sitemaps with a status other than 2xx are not read; with a folder ``failed`` they are
    listed there.  A table without statuses holds fetched sitemaps only.
    """

    def crawl(batch: DataFrame, batch_id: int) -> None:
        fetched = batch
        if "http_status" in batch.columns:
            fetched = fetched_sitemaps(batch)
            if failed is not None:
                failed_sitemaps(batch).drop("xml").write.mode("overwrite").parquet(f"{failed}/batch_id={batch_id}")
        urls = crawl_frontier(fetched, max_pages).select("url")
        if queue is not None:
            urls.write.mode("overwrite").json(f"{queue}/batch_id={batch_id}")
            return
        time = F.current_timestamp() if generated_at is None else generated_at
        found = _found_and_missing(urls, responses(batch.sparkSession))
        _write_crawled(found, time, path, batch_id, checkpoint, dead)

    return _start(sitemaps, checkpoint, crawl, available_now)


def stream_traffic_mix(
    requests: DataFrame,
    path: str,
    checkpoint: str,
    lateness: str = "1 hour",
    available_now: bool = True,
) -> StreamingQuery:
    """Requests per class and hour.  Updated hours replace earlier ones on reading."""
    counted = (
        classify_traffic(requests.withWatermark("ts", lateness))
        .groupBy(F.window("ts", "1 hour").alias("hour"), "type")
        .agg(F.count("*").alias("requests"))
        .select(F.col("hour.start").alias("hour"), "type", "requests")
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return _start(counted, checkpoint, write, available_now, output_mode="update")


def read_traffic_mix(spark: SparkSession, path: str) -> DataFrame:
    """Current counts of a table made by `stream_traffic_mix`."""
    updates = spark.read.schema("hour timestamp, type string, requests bigint, batch_id bigint").parquet(path)
    return updates.groupBy("hour", "type").agg(F.max_by("requests", "batch_id").alias("requests"))
