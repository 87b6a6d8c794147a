"""The resource table."""

import json

import pytest
from pyspark.sql import functions as F

from pagetables.config import work_folder
from pagetables.operators.store import (
    broken_resource_json,
    clear_resources,
    collapse_variants,
    crawl_status_report,
    drop_resources,
    export_resource_json,
    invalid_targets,
    latest_resources,
    parse_resource_json,
    servable_resources,
)
from pagetables.schemas import RESOURCES
from pagetables.sources.readers import read_record_facts, read_resources
from pagetables.sources.writers import compact_resources, write_resource_json, write_resources

RECORD = "key string, status string, generated_at string, markdown string"


def records_of(spark, *rows):
    times = spark.createDataFrame(
        rows, "key string, url string, status string, generated_at string, markdown string, reason string"
    )
    return times.withColumn("generated_at", F.col("generated_at").cast("timestamp"))


def test_servable(spark):
    cases = [
        ("ready", "ready", "2000-01-01 00:00:00", "# x", True),
        ("ready blank", "ready", "2024-01-01 00:00:00", " \n ", False),
        ("ready none", "ready", "2024-01-01 00:00:00", None, False),
        ("stale at the limit", "stale", "2024-01-01 00:00:00", "# x", True),
        ("stale just over", "stale", "2023-12-31 23:59:59.999", "# x", False),
        ("stale within the millisecond", "stale", "2023-12-31 23:59:59.999900", "# x", True),
        ("stale no time", "stale", "yesterday", "# x", False),
        ("failed", "failed", "2024-01-01 00:00:00", "# x", False),
        ("pending", "pending", "2024-01-01 00:00:00", "# x", False),
        ("skipped", "skipped", "2024-01-01 00:00:00", "# x", False),
    ]
    rows = spark.createDataFrame(cases, RECORD + ", want boolean")
    kept = {row.key for row in servable_resources(rows, "2024-01-08 00:00:00").collect()}
    assert kept == {case[0] for case in cases if case[4]}


@pytest.mark.parametrize(
    "window, fresh",
    [(168, True), ("168", True), (167.9, False), ("", False), (" ", False), ("a week", False), ("Infinity", False), ("1e3", True)],
)
def test_windows(spark, window, fresh):
    row = spark.createDataFrame([("k", "stale", "2024-01-01 00:00:00", "x")], RECORD)
    assert (servable_resources(row, "2024-01-08 00:00:00", window).count() == 1) is fresh


def test_last_write_wins_whatever_its_status(spark):
    rows = records_of(
        spark,
        ("a", "u", "ready", "2024-01-01 00:00:00", "good", None),
        ("a", "u", "failed", "2024-01-02 00:00:00", None, "http-500"),
        ("b", "u", "failed", "2024-01-01 00:00:00", None, "http-500"),
    )
    assert {(row.key, row.status) for row in latest_resources(rows).collect()} == {("a", "failed"), ("b", "failed")}
    same_time = spark.createDataFrame(
        [("a", 1, "first", "2024-01-01"), ("a", 2, "second", "2024-01-01")], "key string, seq int, status string, generated_at string"
    )
    assert latest_resources(same_time).first().status == "second"


def test_batches(spark):
    path = work_folder(spark, "batches")
    first = records_of(spark, ("a", "u", "ready", "2024-01-05 00:00:00", "1", None), ("b", "u", "ready", "2024-01-05 00:00:00", "1", None))
    later = records_of(spark, ("a", "u", "failed", "2024-01-01 00:00:00", None, "http-404"))
    write_resources(first, path, 0)
    write_resources(later, path, 1)
    write_resources(later, path, 1)
    current = {row.key: row.status for row in read_resources(spark, path).collect()}
    assert current == {"a": "failed", "b": "ready"}
    compacted = work_folder(spark, "compacted")
    compact_resources(spark, path, compacted)
    again = read_resources(spark, compacted)
    assert again.columns == RESOURCES.fieldNames()
    assert {row.key: row.status for row in again.collect()} == current


def test_json(spark):
    rows = records_of(
        spark,
        ("page:https://e.com/a", "https://e.com/a", "ready", "2024-01-02 03:04:05.678", '# "A"\n', None),
        ("page:https://e.com/b", "https://e.com/b", "failed", "2024-01-02 03:04:05", "left", "http-404"),
    )
    texts = {row.status: row.value for row in export_resource_json(rows).collect()}
    assert texts["ready"] == (
        '{"status":"ready","url":"https://e.com/a","generatedAt":"2024-01-02T03:04:05.678Z","markdown":"# \\"A\\"\\n"}'
    )
    assert list(json.loads(texts["failed"])) == ["status", "url", "generatedAt", "reason"]
    path = work_folder(spark, "json")
    write_resource_json(rows, path)
    assert spark.read.text(f"{path}/status=ready").first().value == texts["ready"]


def test_stored_values_that_are_no_records(spark):
    stored = spark.createDataFrame(
        [("a", '{"status":"ready","markdown":"x"}'), ("b", "null"), ("c", '"text"'), ("d", None), ("e", "[1]")],
        "key string, value string",
    )
    assert [(row.key, row.status, row.markdown) for row in parse_resource_json(stored).collect()] == [("a", "ready", "x")]


def test_dropping_and_clearing(spark):
    rows = spark.createDataFrame([("page:https://e.com/a",), ("page:https://e.com/b",), ("other:x",)], "key string")
    targets = spark.createDataFrame([("https://E.com/a?x#y",), ("page:https://e.com/none",)], "target string")
    assert {row.key for row in drop_resources(rows, targets).collect()} == {"page:https://e.com/b", "other:x"}
    wrong = targets.unionByName(spark.createDataFrame([("no url",), (None,)], "target string"))
    assert {row.target for row in invalid_targets(wrong).collect()} == {"no url", None}
    with pytest.raises(ValueError):
        clear_resources(rows)
    assert [row.key for row in clear_resources(rows, confirm=True).collect()] == ["other:x"]
    assert clear_resources(rows, "none:", confirm=True).count() == 3


def test_reports(spark):
    rows = records_of(
        spark,
        ("a", "https://e.com:8080/a", "failed", None, None, "http-404"),
        ("b", "https://e.com:8080/b", "failed", None, None, "http-404"),
        ("c", "https://f.com/c", "ready", None, "x", None),
    )
    assert {tuple(row) for row in crawl_status_report(rows).collect()} == {
        ("e.com:8080", "failed", "http-404", 2),
        ("f.com", "ready", None, 1),
    }
    pages = spark.createDataFrame([("https://e.com/a?2",), ("https://E.com/a#1",), ("https://e.com/b",)], "url string")
    assert {tuple(row) for row in collapse_variants(pages).collect()} == {
        ("page:https://e.com/a", 2, "https://E.com/a#1"),
        ("page:https://e.com/b", 1, "https://e.com/b"),
    }


def test_work_folder_lies_in_the_shared_folder(spark):
    assert work_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir") + "/x-")


def test_broken_and_foreign_values_are_told_apart(spark):
    stored = spark.createDataFrame(
        [
            ("cut", '{"status":"ready","markdown":"x"'),
            ("open", "{bad"),
            ("number", '{"status":"ready","markdown":5,"url":true}'),
            ("good", ' {"status":"ready","markdown":"x","generatedAt":"2024-01-02T03:04:05.678Z"}'),
        ],
        "key string, value string",
    )
    rows = {row.key: (row.status, row.markdown, row.url) for row in parse_resource_json(stored).collect()}
    assert rows == {"number": ("ready", None, None), "good": ("ready", "x", None)}
    assert {row.key for row in broken_resource_json(stored).collect()} == {"cut", "open"}


def test_two_writers_keep_each_others_batches(spark):
    path = work_folder(spark, "writers")
    row = lambda key, status: records_of(spark, (key, "u", status, "2024-01-01 00:00:00", "# x", None))
    write_resources(row("a", "ready"), path, 0, "one")
    write_resources(row("b", "ready"), path, 0, "two")
    write_resources(row("a", "failed"), path, 0, "two again")
    assert {r.key: r.status for r in read_resources(spark, path).collect()} == {"a": "failed", "b": "ready"}
    facts = {r.key: (r.status, r.markdown_blank, r.markdown_length) for r in read_record_facts(spark, path).collect()}
    assert facts == {"a": ("failed", False, 3), "b": ("ready", False, 3)}
    plan = read_record_facts(spark, path)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.rindex("Project")]
    assert "markdown#" not in above.replace("markdown_blank#", "").replace("markdown_length#", "")
