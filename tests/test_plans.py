"""Shape of the physical plans."""

import re

import pytest

from pagetables.operators.documents import crawl_pages
from pagetables.operators.links import link_graph
from pagetables.operators.render import render_markdown
from pagetables.operators.routing import route_requests
from pagetables.operators.traffic import classify_traffic
from pagetables.plans import views
from pagetables.plans.catalog import QUERIES
from tests.helpers import TESTDATA

SF_DIR = f"{TESTDATA}/sf0.001"
BATCH_QUERIES = sorted(
    name for name in QUERIES if "stream" not in name and not name.startswith(("read_", "write_", "scheduled"))
)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH_QUERIES)
def test_no_python_and_no_cross_join(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    for node in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "CartesianProduct", "NestedLoopJoin"):
        # Rules of a table are tried on the different user agents, which is no equality.
        assert node not in plan or (name, node) in (("classify_with_rules", x) for x in ("NestedLoopJoin", "CartesianProduct"))
    assert "RoundRobin" not in plan


@pytest.mark.parametrize("operator", [link_graph, render_markdown, classify_traffic])
def test_row_jobs_do_not_shuffle(spark, operator):
    view = "requests" if operator is classify_traffic else "pages"
    path = f"{SF_DIR}/pages.parquet"
    source = spark.read.parquet(path) if view == "pages" else spark.read.schema(
        "request_id bigint, user_agent string, accept string"
    ).parquet(f"{SF_DIR}/events.parquet")
    assert "Exchange" not in plan_of(operator(source))


def test_extraction_of_responses_does_not_shuffle(spark):
    responses = spark.read.schema(
        "url string, http_status int, content_type string, html string, fetch_error string"
    ).parquet(f"{SF_DIR}/pages.parquet")
    assert "Exchange" not in plan_of(crawl_pages(responses, "2024-01-01 00:00:00"))


def test_markdown_does_not_reach_the_join(spark):
    requests = views.view(spark, SF_DIR, "requests")
    schema = "key string, url string, status string, generated_at timestamp, markdown string"
    records = spark.read.schema(schema).parquet(f"{SF_DIR}/pages.parquet")
    plan = plan_of(route_requests(requests, records, "2024-01-01 00:00:00"))
    for line in plan.splitlines():
        if "Exchange" in line or "Join" in line:
            assert not re.search(r"\bmarkdown#", line)


def test_only_needed_columns_are_read(spark):
    plan = plan_of(QUERIES["resource_keys"](spark, SF_DIR))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schemas and all("html" not in schema for schema in schemas)
