import pytest

from pagetables.llm.queries import CHECKS, QUERIES
from tests.helpers import TESTDATA, comparable, duckdb_over

SF_DIR = f"{TESTDATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_check(spark, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    want = duckdb_over(SF_DIR).sql(CHECKS[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert comparable(got) == comparable(want)
    assert len(got) > 0


@pytest.mark.parametrize("name", ["op9_source_mix", "op10_license_scan"])
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
