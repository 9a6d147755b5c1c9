"""Every named query against its SQL, and what no plan may contain."""

import pytest
from oracle import compare

import __spark_entry__ as entry
from ledgerlift.plans import all_queries

QUERIES, SQL = all_queries()  # the text queries have tests of their own
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


def test_every_query_has_sql():
    assert sorted(QUERIES) == sorted(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf, name):
    assert compare(spark, name, QUERIES[name], SQL[name], sf) is None


@pytest.mark.parametrize("name", ["reconcile_full", "field_diffs", "reconcile_keyless", "sql_audit", "structure_report", "kv_collect", "number_rows"])
def test_plans_stay_distributed(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not [f for f in FORBIDDEN if f in plan]
    assert "Window" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = QUERIES["keyset_page"](spark, sf).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_orderkey,500)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan


def test_audit_needs_no_shuffle_of_texts(spark, sf):
    plan = QUERIES["sql_audit"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_entry(spark):
    assert entry.entry(spark).columns == ["o_orderkey", "status"]
