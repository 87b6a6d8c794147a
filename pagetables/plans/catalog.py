"""The registered queries: every operator over the given tables.

Every query takes a session and the folder of the tables.  Values of nested types are
written as text, so that results compare by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import prepare_session, work_folder
from ..operators import (
    content,
    documents,
    links,
    metadata,
    render,
    routing,
    sitemap,
    store,
    structured,
    tables,
    traffic,
)
from ..rules import AI_AGENT, SEARCH_CRAWLER, BotRule
from ..schemas import BOT_RULES
from ..sources import readers, writers
from ..streaming import jobs
from .views import table, view

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = "2024-01-05 00:00:00"
GENERATED_AT = "2024-01-02 03:04:05.678"
ORIGIN = "https://App.example.com:443/base/"
CUSTOM_RULES = (
    BotRule(AI_AGENT, "DeskAgent", "regex", "(?i)deskagent", 0),
    BotRule(AI_AGENT, "Curl", "substring", "CURL/", 1),
    BotRule(SEARCH_CRAWLER, "Mine", "substring", "my crawler", 2),
)

QUERIES: dict[str, Query] = {}


def _query(build: Query) -> Query:
    def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(prepare_session(spark), sf_dir)

    QUERIES[build.__name__] = prepared
    return build


def _lines(texts: Column) -> Column:
    return F.array_join(texts, "\n")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


# --- sources and sinks ------------------------------------------------------------


def _http_log(requests: DataFrame) -> DataFrame:
    """Server log with raw targets and header maps, from the request view."""
    target = F.regexp_replace("url", "^[a-z]+://[^/]*", "")
    return requests.select(
        "request_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.nullif("method", F.lit("GET")).alias("method"),
        F.when(F.col("request_id") % 2 == 0, "/ignored").otherwise(target).alias("url"),
        F.when(F.col("request_id") % 2 == 0, target).alias("original_url"),
        F.create_map(
            F.lit("User-Agent"), F.array("user_agent"), F.lit("ACCEPT"), F.array("accept", F.lit("text/plain"))
        ).alias("headers"),
    )


@_query
def read_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "http-log")
    _http_log(view(spark, sf_dir, "requests")).write.parquet(path)
    return readers.read_requests(spark, path, ORIGIN).select(
        "request_id", "method", "url", "user_agent", "accept"
    )


@_query
def read_resource_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored texts, of which those of pending records are cut off."""
    path = work_folder(spark, "stored-json")
    stored = store.export_resource_json(view(spark, sf_dir, "resources"))
    cut = F.when(F.col("status") == "pending", F.substring("value", 1, 25)).otherwise(F.col("value"))
    stored.select("key", cut.alias("value")).write.parquet(path)
    return _resource_columns(readers.read_resource_json(spark, path))


@_query
def write_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, compacted = work_folder(spark, "resources"), work_folder(spark, "compacted")
    writers.write_resources(view(spark, sf_dir, "resources"), path, 0)
    writers.write_resources(view(spark, sf_dir, "resource_history"), path, 1)
    writers.compact_resources(spark, path, compacted)
    return _resource_columns(readers.read_resources(spark, compacted))


@_query
def export_resource_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.export_resource_json(view(spark, sf_dir, "resource_history"))


def _resource_columns(resources: DataFrame) -> DataFrame:
    return resources.select(
        "key", "url", "status", documents.iso_time(F.col("generated_at")).alias("generated_at"), "markdown", "reason"
    )


# --- pages --------------------------------------------------------------------------


@_query
def resource_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.resource_keys(_pages(spark, sf_dir))


@_query
def collapse_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.collapse_variants(_pages(spark, sf_dir))


@_query
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.page_metadata(view(spark, sf_dir, "pages_enriched"))


@_query
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.html_tables(view(spark, sf_dir, "pages_enriched"))
    return rows.withColumn("cells", F.array_join("cells", " | "))


@_query
def structured_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structured.structured_entities(view(spark, sf_dir, "pages_enriched"))
    crumbs = F.transform("breadcrumbs", lambda c: F.concat(c["name"], F.lit(" "), c.url))
    return found.select(
        "page_id",
        "node_no",
        "entity",
        "name",
        "url",
        "description",
        _lines(F.col("same_as")).alias("same_as"),
        "category",
        "operating_system",
        _lines(F.col("features")).alias("features"),
        "offer_url",
        F.coalesce(_lines(crumbs), F.lit("")).alias("breadcrumbs"),
    )


@_query
def structured_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured.structured_markdown(view(spark, sf_dir, "pages_enriched"))


@_query
def content_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.content_profile(_pages(spark, sf_dir))


@_query
def link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.link_graph(_pages(spark, sf_dir))


@_query
def link_in_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.link_in_degree(links.link_graph(_pages(spark, sf_dir)))


@_query
def uncrawled_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = links.link_graph(view(spark, sf_dir, "pages_enriched"))
    return links.uncrawled_links(edges, view(spark, sf_dir, "resources"))


@_query
def render_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.render_markdown(view(spark, sf_dir, "pages_enriched"))


@_query
def build_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.build_documents(view(spark, sf_dir, "pages_enriched"), GENERATED_AT)


@_query
def crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = documents.crawl_pages(view(spark, sf_dir, "responses"), GENERATED_AT)
    return _resource_columns_with_reason(records)


def _resource_columns_with_reason(records: DataFrame) -> DataFrame:
    return records.withColumn("generated_at", documents.iso_time(F.col("generated_at")))


@_query
def crawl_status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.crawl_status_report(
        documents.crawl_pages(view(spark, sf_dir, "responses"), GENERATED_AT)
    )


# --- sitemaps -----------------------------------------------------------------------


@_query
def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitemap.sitemap_urls(view(spark, sf_dir, "sitemaps"))


@_query
def crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitemap.crawl_frontier(view(spark, sf_dir, "sitemaps"), "2")


@_query
def crawl_run_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit of a run is the feature: the first 100 URLs over all sitemaps."""
    return sitemap.crawl_run_frontier(view(spark, sf_dir, "sitemaps"), 100)


@_query
def read_sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed sitemaps; every fifth was not fetched and is not read."""
    path = work_folder(spark, "sitemaps")
    status = F.when(F.col("sitemap_id") % 5 == 0, 503).otherwise(200)
    view(spark, sf_dir, "sitemaps").select(
        F.concat(F.lit("https://example.com/map"), F.col("sitemap_id").cast("string")).alias("sitemap_url"),
        status.alias("http_status"),
        "xml",
        F.lit(GENERATED_AT).cast("timestamp").alias("fetched_at"),
    ).write.parquet(path)
    return sitemap.sitemap_urls(readers.read_sitemaps(spark, path))


@_query
def crawl_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    frontier = sitemap.crawl_frontier(view(spark, sf_dir, "sitemaps"))
    misses = routing.warmup_queue(view(spark, sf_dir, "requests"), view(spark, sf_dir, "resources"))
    return routing.crawl_candidates(frontier, misses)


# --- requests -----------------------------------------------------------------------


@_query
def page_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.page_requests(view(spark, sf_dir, "requests")).select("request_id", "method", "url")


@_query
def classify_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.classify_traffic(view(spark, sf_dir, "requests")).select("request_id", "type", "name")


@_query
def classify_with_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(r.priority, r.traffic, r.name, r.kind, r.pattern) for r in CUSTOM_RULES]
    rules = spark.createDataFrame(rows, BOT_RULES)
    labelled = traffic.classify_with_rules(view(spark, sf_dir, "requests"), rules)
    return labelled.select("request_id", "type", "name")


@_query
def traffic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.traffic_mix(view(spark, sf_dir, "requests"))


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route_requests(view(spark, sf_dir, "requests"), view(spark, sf_dir, "resources"), AS_OF)


@_query
def route_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).drop("ts")


@_query
def route_requests_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    replayed = routing.route_requests_asof(
        view(spark, sf_dir, "requests"), view(spark, sf_dir, "resource_history")
    )
    return replayed.drop("ts")


@_query
def warmup_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.warmup_queue(view(spark, sf_dir, "requests"), view(spark, sf_dir, "resources"))


@_query
def serve_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.serve_coverage(_routed(spark, sf_dir))


# --- resources ----------------------------------------------------------------------


@_query
def servable_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.servable_resources(view(spark, sf_dir, "resource_history"), AS_OF).select(
        "key", "status", "markdown"
    )


@_query
def latest_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resource_columns(store.latest_resources(view(spark, sf_dir, "resource_history")))


@_query
def drop_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop the pages that end in .html by URL and the Spanish ones by key."""
    pages = _pages(spark, sf_dir)
    by_url = pages.filter(F.contains("url", F.lit(".html"))).select(F.col("url").alias("target"))
    by_key = (
        store.resource_keys(pages).filter(F.contains("url", F.lit("/es/"))).select(F.col("key").alias("target"))
    )
    return store.drop_resources(view(spark, sf_dir, "resources"), by_url.unionByName(by_key)).select("key", "status")


@_query
def clear_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.clear_resources(view(spark, sf_dir, "resources"), "page:https:", confirm=True).select(
        "key", "status"
    )


# --- streams ------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


def _request_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = view(spark, sf_dir, "requests", events=_stream(spark, sf_dir, "events"))
    return requests.withColumn("ts", F.col("ts").cast("timestamp"))


def _folders(spark: SparkSession, name: str) -> tuple[str, str]:
    return work_folder(spark, name), work_folder(spark, f"{name}-checkpoint")


@_query
def stream_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, checkpoint = _folders(spark, "stream-route")
    table = work_folder(spark, "stream-route-records")
    writers.write_resources(view(spark, sf_dir, "resources"), table, 0)
    jobs.stream_route(
        _request_stream(spark, sf_dir),
        lambda session: readers.read_record_facts(session, table),
        path,
        checkpoint,
        AS_OF,
    ).awaitTermination()
    return spark.read.parquet(path).drop("batch_id", "ts")


@_query
def stream_warmup_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, checkpoint = _folders(spark, "stream-warmup")
    jobs.stream_warmup_queue(
        _request_stream(spark, sf_dir), lambda session: view(session, sf_dir, "resources"), path, checkpoint
    ).awaitTermination()
    return spark.read.parquet(path).select("key", "url")


@_query
def stream_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, checkpoint = _folders(spark, "stream-crawl")
    responses = view(spark, sf_dir, "responses", pages=_stream(spark, sf_dir, "pages"))
    jobs.stream_crawl(responses, path, checkpoint, GENERATED_AT).awaitTermination()
    return _stored_records(spark, path)


def _landed_responses(spark: SparkSession, sf_dir: str) -> str:
    path = work_folder(spark, "responses")
    writers.write_responses(view(spark, sf_dir, "responses"), path, 0)
    return path


@_query
def stream_crawl_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, checkpoint = _folders(spark, "stream-crawl-queue")
    # A third kind of message has no URL and a fourth a blank one.
    messages = _stream(spark, sf_dir, "pages").select(
        F.explode(F.array("url", "url", F.lit(None).cast("string"), F.lit(""))).alias("url")
    )
    landed = _landed_responses(spark, sf_dir)
    jobs.stream_crawl_queue(
        messages, lambda session: readers.read_response_store(session, landed), path, checkpoint, GENERATED_AT
    ).awaitTermination()
    return _stored_records(spark, path)


@_query
def scheduled_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, checkpoint = _folders(spark, "scheduled-crawl")
    sitemaps = view(spark, sf_dir, "sitemaps", pages=_stream(spark, sf_dir, "pages"))
    landed = _landed_responses(spark, sf_dir)
    jobs.scheduled_crawl(
        sitemaps,
        lambda session: readers.read_response_store(session, landed),
        path,
        checkpoint,
        generated_at=GENERATED_AT,
    ).awaitTermination()
    return _stored_records(spark, path)


def _stored_records(spark: SparkSession, path: str) -> DataFrame:
    return _resource_columns_with_reason(readers.read_resources(spark, path))


@_query
def stream_traffic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, checkpoint = _folders(spark, "stream-traffic-mix")
    jobs.stream_traffic_mix(_request_stream(spark, sf_dir), path, checkpoint).awaitTermination()
    return jobs.read_traffic_mix(spark, path).withColumn("hour", documents.iso_time(F.col("hour")))
