"""Records are made once for a query, however often it reads them."""

import pytest

from factloom.plans import compare_queries, ingestion_queries, mechanic_queries

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_two_runs_are_compared_in_one_pass(spark):
    assert _plan(compare_queries.drift_levels(spark, SF)).count("vocabulary(") == 1


@pytest.mark.parametrize("name", ["retained_merge", "trace_entries"])
def test_what_is_read_twice_is_written_first(spark, name):
    plan = _plan(mechanic_queries.QUERIES[name](spark, SF))
    assert "vocabulary(" not in plan and "text#" not in plan  # no texts of documents are read


def test_facts_of_jobs_are_counted_where_they_are_made(spark):
    assert _plan(ingestion_queries.batch_report(spark, SF)).count("vocabulary(") == 1
