"""Streams over several micro-batches, retries and queues."""

from pyspark.sql import functions as F

from pagetables.config import work_folder
from pagetables.schemas import CRAWL_MESSAGES
from pagetables.sources.readers import read_crawl_messages, read_resources, read_responses
from pagetables.streaming import jobs

TIME = "2024-01-02 00:00:00"
RESPONSE = "url string, http_status int, content_type string, html string, fetched_at timestamp, fetch_error string"


def land(spark, path, *rows):
    spark.createDataFrame([(*row, None, None) for row in rows], RESPONSE).coalesce(1).write.mode("append").parquet(path)


def test_crawl_over_batches_and_restarts(spark):
    landed, table, checkpoint = (work_folder(spark, name) for name in ("landed", "table", "checkpoint"))
    page = ("https://e.com/a", 200, "text/html", "<main>one</main>")
    land(spark, landed, page, ("https://e.com/b", 200, "text/html", "<main>b</main>"))
    for _ in range(2):
        jobs.stream_crawl(read_responses(spark, landed, streaming=True), table, checkpoint, TIME).awaitTermination()
    land(spark, landed, ("https://e.com/a?again", 404, "text/html", ""))
    jobs.stream_crawl(read_responses(spark, landed, streaming=True), table, checkpoint, TIME).awaitTermination()
    rows = {row.key: (row.status, row.reason) for row in read_resources(spark, table).collect()}
    assert rows == {"page:https://e.com/a": ("failed", "http-404"), "page:https://e.com/b": ("ready", None)}


def test_scheduled_crawl_feeds_the_queue(spark):
    sitemaps, queue, table, first, second = (
        work_folder(spark, name) for name in ("sitemaps", "queue", "table", "first", "second")
    )
    xml = "<loc>https://e.com/a</loc><loc>https://e.com/b</loc><loc>https://e.com/c</loc>"
    spark.createDataFrame([("s", xml)], "sitemap_url string, xml string").write.parquet(sitemaps)
    stream = spark.readStream.schema("sitemap_url string, xml string").parquet(sitemaps)
    jobs.scheduled_crawl(stream, lambda session: None, table, first, 2, TIME, queue=queue).awaitTermination()

    spark.createDataFrame([(None,), ("",)], CRAWL_MESSAGES).write.mode("append").json(f"{queue}/batch_id=9")
    spark.createDataFrame([("https://E.com/gone?x",), ("no url",)], CRAWL_MESSAGES).write.mode("append").json(f"{queue}/batch_id=9")
    responses = spark.createDataFrame(
        [(f"https://e.com/{name}", 200, "text/html", f"<main>{name}</main>", None) for name in "abc"],
        "url string, http_status int, content_type string, html string, fetch_error string",
    )
    messages = read_crawl_messages(spark, queue)
    dead = work_folder(spark, "dead")
    jobs.stream_crawl_queue(messages, lambda session: responses, table, second, TIME, dead=dead).awaitTermination()
    rows = {row.url: (row.status, row.reason) for row in read_resources(spark, table).collect()}
    assert rows == {
        "https://e.com/a": ("ready", None),
        "https://e.com/b": ("ready", None),
        "https://e.com/gone": ("failed", "not-landed"),
    }
    assert [row.url for row in spark.read.parquet(dead).collect()] == ["no url"]


def test_sitemaps_that_failed_are_not_read(spark):
    sitemaps, table, checkpoint, failed = (work_folder(spark, name) for name in ("sitemaps", "table", "checkpoint", "failed"))
    rows = [("good", 200, "<loc>https://e.com/a</loc>"), ("bad", 404, "<loc>https://e.com/b</loc>"), ("none", None, "<loc>https://e.com/c</loc>")]
    schema = "sitemap_url string, http_status int, xml string"
    spark.createDataFrame(rows, schema).write.parquet(sitemaps)
    stream = spark.readStream.schema(schema).parquet(sitemaps)
    responses = spark.createDataFrame([], RESPONSE)
    jobs.scheduled_crawl(stream, lambda session: responses, table, checkpoint, None, TIME, failed=failed).awaitTermination()
    assert [(row.url, row.reason) for row in read_resources(spark, table).collect()] == [("https://e.com/a", "not-landed")]
    assert {row.sitemap_url for row in spark.read.parquet(failed).collect()} == {"bad", "none"}


def test_two_jobs_on_one_table(spark):
    landed, table = work_folder(spark, "landed"), work_folder(spark, "table")
    for i in range(2):
        land(spark, f"{landed}/{i}", (f"https://e.com/{i}", 200, "text/html", "<main>x</main>"))
        stream = read_responses(spark, f"{landed}/{i}", streaming=True)
        jobs.stream_crawl(stream, table, work_folder(spark, "checkpoint"), TIME).awaitTermination()
    assert {row.url for row in read_resources(spark, table).collect()} == {"https://e.com/0", "https://e.com/1"}


def test_records_written_between_batches_are_seen(spark):
    log, path, checkpoint = (work_folder(spark, name) for name in ("log", "routed", "checkpoint"))
    schema = "request_id bigint, ts timestamp, method string, url string, user_agent string, accept string"
    known = [[], [("page:https://e.com/a", "https://e.com/a", "ready", TIME, "# A")]]

    def records(session):
        rows = session.createDataFrame(known[0], "key string, url string, status string, generated_at string, markdown string")
        return rows.withColumn("generated_at", F.col("generated_at").cast("timestamp"))

    for i in range(2):
        row = spark.createDataFrame([(i, "GET", "https://e.com/a", "GPTBot/1.0")], "request_id bigint, method string, url string, user_agent string")
        row.withColumn("ts", F.lit(TIME).cast("timestamp")).withColumn("accept", F.lit("")).select(
            "request_id", "ts", "method", "url", "user_agent", "accept"
        ).write.mode("append").parquet(log)
        stream = spark.readStream.schema(schema).parquet(log)
        jobs.stream_route(stream, records, path, checkpoint, TIME).awaitTermination()
        known.pop(0) if i == 0 else None
    decisions = {row.request_id: row.decision for row in spark.read.parquet(path).collect()}
    assert decisions == {0: "origin_warm", 1: "serve_markdown"}


def test_last_fetch_of_a_batch_wins(spark):
    landed, table, checkpoint = (work_folder(spark, name) for name in ("landed", "table", "checkpoint"))
    rows = [
        ("https://e.com/a", 200, "text/html", "<main>new</main>", "2024-01-03 00:00:00", None),
        ("https://e.com/a?x", 404, "text/html", "", "2024-01-02 00:00:00", None),
    ]
    fields = RESPONSE.replace("fetched_at timestamp", "fetched_at string")
    spark.createDataFrame(rows, fields).withColumn("fetched_at", F.col("fetched_at").cast("timestamp")).write.parquet(landed)
    jobs.stream_crawl(read_responses(spark, landed, streaming=True), table, checkpoint, TIME).awaitTermination()
    assert [row.status for row in read_resources(spark, table).collect()] == ["ready"]
