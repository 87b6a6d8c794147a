"""Bucketed tables: what is read, what is moved, how a hot key is spread."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pagetables import schemas
from pagetables.config import work_folder
from pagetables.operators.routing import route_requests
from pagetables.operators.store import latest_resources
from pagetables.sources import buckets
from pagetables.sources.readers import read_record_facts, read_resources, read_response_store
from pagetables.sources.writers import compact_resources, write_resources, write_responses
from pagetables.streaming import jobs

RECORD = "key string, url string, status string, generated_at timestamp, markdown string, reason string, seq bigint"
RESPONSE = "url string, http_status int, content_type string, html string, fetched_at timestamp, fetch_error string"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def moved(plan, column):
    return [line for line in plan.splitlines() if re.search(r"Exchange|Sort |Sort\[", line) and re.search(rf"\b{column}#", line)]


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def some_records(spark, rng, n):
    rows = [
        (f"page:https://e.com/{rng.randrange(40)}", "u", rng.choice(["ready", "failed"]), None, f"# {i}", None, rng.randrange(5))
        for i in range(n)
    ]
    frame = spark.createDataFrame(rows, RECORD)
    return frame.withColumn("generated_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.hash("markdown") % 3))


def test_current_records_equal_the_fold_of_all_writes(spark):
    rng, path = random.Random(1), work_folder(spark, "log")
    whole = None
    for batch in range(3):
        # equal writes have no order; here the text tells them apart
        records = latest_resources(some_records(spark, rng, 120), "generated_at", "seq", "markdown")
        write_resources(records, path, batch, buckets=4)
        numbered = records.withColumn("batch", F.lit(batch))
        whole = numbered if whole is None else whole.unionByName(numbered)
    want = latest_resources(whole, "batch").select(*schemas.RESOURCES.fieldNames())
    got = read_resources(spark, path)
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    facts = {row.key: (row.status, row.markdown_blank, row.markdown_length) for row in read_record_facts(spark, path).collect()}
    assert facts == {row.key: (row.status, False, len(row.markdown)) for row in got.collect()}
    new = work_folder(spark, "compacted")
    compact_resources(spark, path, new, buckets=8)
    assert sorted(read_resources(spark, new).collect(), key=str) == sorted(got.collect(), key=str)
    assert buckets.bucket_count(spark, path) == 4 and buckets.bucket_count(spark, new) == 8


def test_a_later_write_wins_inside_a_batch(spark):
    path = work_folder(spark, "log")
    rows = [("k", "u", "ready", None, "old", None, 1), ("k", "u", "ready", None, "new", None, 2), ("k", "u", "ready", None, "none", None, None)]
    write_resources(spark.createDataFrame(rows, RECORD), path, 0)
    assert [row.markdown for row in read_resources(spark, path).collect()] == ["new"]
    same = [("k", "u", "ready", None, str(i), None, 9) for i in range(50)]
    write_resources(spark.createDataFrame(same, RECORD).repartition(4), path, 1)
    assert read_resources(spark, path).count() == 1
    assert read_resources(spark, work_folder(spark, "empty")).collect() == []


def test_markdown_is_never_moved(spark, no_broadcast):
    path = work_folder(spark, "log")
    records = some_records(spark, random.Random(2), 100)
    write_resources(records, path, 0)
    plan = plan_of(read_resources(spark, path))
    assert "ShuffledHashJoin" in plan and "Bucketed: true" in plan
    assert moved(plan, "markdown") == []
    facts = plan_of(read_record_facts(spark, path))
    assert all("markdown:" not in found for found in re.findall(r"ReadSchema: struct<([^>]*)>", facts))

    name = buckets.declared(spark, path, schemas.RESOURCE_LOG, schemas.BATCHES)
    spark.table(name).drop("writer", "batch_id").createOrReplaceTempView("rows_to_write")
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", str(buckets.OPEN_FILES))
    statement = buckets.insert_statement(name, "rows_to_write", {"writer": "x", "batch_id": 5}).replace("OVERWRITE", "INTO")
    written = spark.sql("EXPLAIN " + statement).first()[0]
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", "0")
    assert "WriteFiles" in written and "Sort" not in written and "Exchange" not in written


def test_routing_by_stored_facts(spark):
    path = work_folder(spark, "log")
    write_resources(some_records(spark, random.Random(3), 100), path, 0)
    requests = spark.createDataFrame(
        [(i, None, "GET", f"https://e.com/{i}", "ClaudeBot/9.9", None) for i in range(60)],
        "request_id bigint, ts timestamp, method string, url string, user_agent string, accept string",
    )
    by_facts = route_requests(requests, read_record_facts(spark, path), "2024-01-01 00:00:00")
    by_records = route_requests(requests, read_resources(spark, path), "2024-01-01 00:00:00")
    assert sorted(by_facts.collect(), key=str) == sorted(by_records.collect(), key=str)
    plan = plan_of(by_facts)
    assert all("markdown:" not in found for found in re.findall(r"ReadSchema: struct<([^>]*)>", plan))


def landed(spark, path, n):
    rows = [(f"https://e.com/{i % 70}?v={i}", 200, "text/html", f"<main>{i}</main>", None, None) for i in range(n)]
    rows += [("no url", 200, "text/html", "<main>x</main>", None, None), (None, 200, "text/html", "y", None, None)]
    write_responses(spark.createDataFrame(rows, RESPONSE), path, 0)


@pytest.mark.parametrize("queued", [3, 500])
def test_queue_reads_wanted_responses_only(spark, no_broadcast, queued):
    path = work_folder(spark, "responses")
    landed(spark, path, 200)
    urls = spark.createDataFrame(
        [(f"https://e.com/{i}",) for i in range(60, 60 + queued)] + [(None,), ("",), ("no url",), ("also none",)], "url string"
    )
    found = jobs._found_and_missing(urls, read_response_store(spark, path))
    plain = spark.table(buckets.declared(spark, path, schemas.RESPONSE_STORE, schemas.BATCHES)).select(*schemas.RESPONSES.fieldNames())
    want = jobs._found_and_missing(urls, plain.filter("url IS NOT NULL"))
    assert sorted(map(str, found.collect())) == sorted(map(str, want.select(*found.columns).collect()))
    plan = plan_of(found)
    assert moved(plan, "html") == [] and "ShuffledHashJoin" in plan
    reads = [int(a) for a in re.findall(r"SelectedBucketsCount: (\d+) out of 32", plan)]
    if queued == 3:
        assert reads and max(reads) < 32


def test_a_hot_key_is_spread(spark):
    path = work_folder(spark, "responses")
    rows = spark.range(4000).select(
        F.lit("https://e.com/hot").alias("url"), F.lit(200).alias("http_status"), F.lit("text/html").alias("content_type"),
        F.repeat(F.lit("x"), 100).alias("html"),
    )
    write_responses(rows, path, 0)
    spread = read_response_store(spark, path).groupBy("place").count().collect()
    assert len(spread) == buckets.SALTS and max(row["count"] for row in spread) < 2 * 4000 / buckets.SALTS
    urls = spark.createDataFrame([("https://e.com/hot#x",)], "url string")
    assert jobs._found_and_missing(urls, read_response_store(spark, path)).count() == 4000
