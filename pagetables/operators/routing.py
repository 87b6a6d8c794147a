"""Routing decisions for requests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exprs import settle
from ..functions.urls import page_url
from ..rules import AI_AGENT
from .store import instant, is_servable, markdown_is_blank
from .traffic import classify_traffic, is_page_request

MARKDOWN_TYPE = "text/markdown; charset=utf-8"
PASSTHROUGH, SERVE, ORIGIN, WARM = "passthrough", "serve_markdown", "origin", "origin_warm"

_LOG_FIELDS = ("request_id", "ts", "method", "type", "name")


def _labelled(requests: DataFrame) -> DataFrame:
    """Requests with class, page URL and whether they need a record."""
    classified = classify_traffic(requests).withColumn("page", page_url("url"))
    needs_record = is_page_request(F.col("method"), F.col("page")) & (F.col("type") == AI_AGENT)
    return settle(
        classified, *_LOG_FIELDS, "page", F.coalesce(needs_record, F.lit(False)).alias("lookup")
    )


def agent_page_requests(requests: DataFrame) -> DataFrame:
    """AI-agent page requests with their resource key: the only ones to look up."""
    return (
        _labelled(requests)
        .filter("lookup")
        .select(*_LOG_FIELDS, "page", F.concat(F.lit("page:"), "page").alias("key"))
    )


def record_facts(resources: DataFrame) -> DataFrame:
    """What a decision needs of a record.  The Markdown stays behind.

    A table made by `read_record_facts` has the facts of the Markdown already.
    """
    known = "markdown_blank" in resources.columns
    return resources.select(
        "key",
        F.col("url").alias("record_url"),
        "status",
        instant(resources, "generated_at"),
        (F.col("markdown_blank") if known else markdown_is_blank(F.col("markdown"))).alias("markdown_blank"),
        (F.col("markdown_length") if known else F.length("markdown")).cast("bigint").alias("markdown_length"),
        F.lit(True).alias("stored"),
        *(["seq"] if "seq" in resources.columns else []),
    )


def _decide(found: DataFrame, as_of: Column, window_hours: float | int | str) -> DataFrame:
    """Decision columns; no record means NULL facts, no lookup a request passed through."""
    servable = is_servable(
        F.col("status"), F.col("generated_at"), F.col("markdown_blank"), as_of, window_hours
    )
    served = F.col("decision") == SERVE
    return found.withColumn(
        "decision",
        F.when(~F.col("lookup"), PASSTHROUGH)
        .when(servable, SERVE)
        .when(F.col("stored").isNull() & (F.col("method") == "GET"), WARM)
        .otherwise(ORIGIN),
    ).select(
        *_LOG_FIELDS,
        F.concat(F.lit("page:"), "page").alias("key"),
        "decision",
        F.when(served, MARKDOWN_TYPE).alias("content_type"),
        F.when(served, F.col("status")).alias("resource_state"),
        F.when(served, F.coalesce(page_url("record_url"), F.col("page"))).alias("canonical_url"),
        F.when(served, F.col("markdown_length")).alias("markdown_length"),
    )


def _spread_key() -> Column:
    """Hash over a request: spreads the requests of a page, and those without a page."""
    return F.xxhash64("request_id", "ts", "method", "name", "page")


def _with_lookup_key(requests: DataFrame) -> DataFrame:
    """Labelled requests with the key to look up, and one that no record has for the others.

    So one pass over the log serves both, and the others are spread by their hash.
    """
    nowhere = F.concat(F.lit("#"), _spread_key().cast("string"))
    return _labelled(requests).withColumn(
        "key", F.when(F.col("lookup"), F.concat(F.lit("page:"), "page")).otherwise(nowhere)
    )


def route_requests(
    requests: DataFrame,
    resources: DataFrame,
    as_of: datetime | str | Column,
    window_hours: float | int | str = 168,
) -> DataFrame:
    """Decision per request against one version of the resource table.

    The log is read and classified once.  Requests that need no record get a key without
    one.  The join side is left to the optimizer: it broadcasts a small table, so that
    nothing of the log moves, and splits hot pages of a large one.
    """
    time = as_of if isinstance(as_of, Column) else F.lit(as_of)
    facts = record_facts(resources).drop("seq")
    return _decide(_with_lookup_key(requests).join(facts, "key", "left"), time, window_hours)


def warmup_queue(requests: DataFrame, resources: DataFrame) -> DataFrame:
    """Pages asked for by AI agents that have no record.

    Requests are counted per page before the join, so a hot page is one row.
    """
    wanted = (
        agent_page_requests(requests)
        .filter(F.col("method") == "GET")
        .groupBy("key")
        .agg(
            F.min("ts").alias("first_requested_at"),
            F.min("page").alias("url"),
            F.count("*").alias("requests"),
        )
    )
    return wanted.join(resources.select("key"), "key", "left_anti").select(
        "key", "url", "first_requested_at", "requests"
    )


def serve_coverage(routed: DataFrame) -> DataFrame:
    """Per agent: how many page requests were served, left to the origin, warmed."""

    def share(decision: str) -> Column:
        return F.count_if(F.col("decision") == decision)

    counted = (
        routed.filter(F.col("decision") != PASSTHROUGH)
        .groupBy("name")
        .agg(
            F.count("*").alias("requests"),
            share(SERVE).alias("served"),
            share(ORIGIN).alias("at_origin"),
            share(WARM).alias("warmed"),
        )
    )
    return counted.withColumn("served_share", F.col("served").cast("double") / F.col("requests").cast("double"))


def invalid_candidates(frontier: DataFrame) -> DataFrame:
    """URLs of a frontier that are not valid, to report: `crawl_candidates` leaves them out."""
    return frontier.filter(page_url("url").isNull())


def crawl_candidates(frontier: DataFrame, warmups: DataFrame) -> DataFrame:
    """Sitemap URLs and missed pages as one crawl list, one row per key."""
    both = (
        frontier.select(page_url("url").alias("url"), F.lit("sitemap").alias("source"))
        .filter(F.col("url").isNotNull())
        .unionByName(warmups.select("url", F.lit("miss").alias("source")))
        .withColumn("key", F.concat(F.lit("page:"), "url"))
    )
    # At most two distinct sources per key.
    return both.groupBy("key").agg(
        F.min("url").alias("url"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources")
    )


# --- replay -------------------------------------------------------------------------

_FACTS = ("record_url", "status", "generated_at", "markdown_blank", "markdown_length", "stored")


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def route_requests_asof(
    requests: DataFrame,
    history: DataFrame,
    window_hours: float | int | str = 168,
    bucket_seconds: int = 3_600,
    salts: int = 16,
) -> DataFrame:
    """Decision per request with the record as stored at the request's own time.

    An as-of window per key would put a hot page into one task.  Instead, time is cut
    into buckets: a narrow table of keys and buckets carries the last earlier record
    into every bucket with requests, and the as-of window runs per key, bucket and salt.
    Every request is salted by its hash, and the few records of a bucket are repeated for
    each salt, so no list of hot pages is needed.  Of records of one time the last write
    (``seq``, if there is one) counts.
    """
    width = bucket_seconds * 1_000_000

    def bucketed(frame: DataFrame) -> DataFrame:
        return frame.withColumn("bucket", F.floor(F.col("at") / width).cast("bigint"))

    probes = bucketed(_with_lookup_key(requests).withColumn("at", _micros(F.col("ts"))))
    facts = record_facts(history)
    order = F.struct(*([F.col("seq")] if "seq" in facts.columns else []), F.struct(*_FACTS))
    versions = bucketed(
        facts.select("key", _micros(F.col("generated_at")).alias("at"), F.struct(*_FACTS).alias("facts"), order.alias("order"))
        .groupBy("key", "at")
        .agg(F.max_by("facts", "order").alias("facts"))
    )

    request_buckets = probes.filter("lookup").groupBy("key", "bucket").agg(F.count("*").alias("requests"))
    last_versions = versions.groupBy("key", "bucket").agg(
        F.max_by(F.struct("at", "facts"), "at").alias("last")
    )
    earlier = Window.partitionBy("key").orderBy("bucket", F.col("requests").desc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    # Requests of a bucket sort before its own last version, which they must not see here.
    carried = (
        request_buckets.unionByName(last_versions, allowMissingColumns=True)
        .withColumn("before", F.last("last", ignorenulls=True).over(earlier))
        .filter(F.col("requests").isNotNull() & F.col("before").isNotNull())
        .select("key", "bucket", "before.at", "before.facts")
    )
    log_columns = [*_LOG_FIELDS, "page", "lookup"]
    salted = probes.select(
        "key",
        "bucket",
        F.pmod(_spread_key(), F.lit(salts)).cast("int").alias("salt"),
        "at",
        F.lit(1).alias("side"),
        F.struct(*log_columns).alias("request"),
    )
    records = (
        versions.select("key", "bucket", "at", "facts")
        .unionByName(carried)
        .select("key", "bucket", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "at", F.lit(0).alias("side"), "facts")
    )
    as_of = (
        Window.partitionBy("key", "bucket", "salt")
        .orderBy("at", "side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    seen = (
        salted.unionByName(records, allowMissingColumns=True)
        .withColumn("facts", F.last("facts", ignorenulls=True).over(as_of))
        .filter(F.col("side") == 1)
        .select("request.*", "facts.*")
    )
    return _decide(seen, F.col("ts"), window_hours)
