"""Every registered query equals its DuckDB check."""

import pytest

import __spark_entry__ as driver
from pagetables.plans.catalog import QUERIES
from pagetables.plans.checks import CHECKS
from tests.helpers import TESTDATA, comparable, duckdb_over

SF_DIR = f"{TESTDATA}/sf0.001"


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)
    assert QUERIES.items() <= driver.queries().items() and CHECKS.items() <= driver.oracle_sql().items()


def test_entry_gives_a_stable_schema(spark):
    result = driver.entry(spark)
    assert result.columns[:5] == ["request_id", "method", "type", "name", "key"]
    assert result.count() == 1_000


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_check(spark, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    want = duckdb_over(SF_DIR).sql(CHECKS[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert comparable(got) == comparable(want)
    assert len(got) > 0
