import pytest
from helpers import SMALL, in_duckdb, same_rows

import __spark_entry__ as entry
from ridgeline.plans import events, relational

NAMES = [f.__name__ for f in (*relational.QUERIES, *events.QUERIES) if f.__name__ in entry.oracle_sql()]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    same_rows(entry.queries()[name](spark, SMALL), in_duckdb(entry.oracle_sql()[name]))


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0


def test_scans_are_pruned(spark):
    plan = relational.pricing_summary(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan and "l_partkey" not in plan
