"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import __spark_entry__
import pytest
from compare import compare

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = __spark_entry__.queries(), __spark_entry__.oracle_sql()
SQL_TYPES = {
    "bigint": "bigint",
    "int": "integer",
    "string": "varchar",
    "double": "double",
    "boolean": "boolean",
    "date": "date",
    "timestamp_ntz": "timestamp",
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    result = compare(spark, QUERIES[name], ORACLES[name], FOLDER)
    assert result["equal"], result["diff"]
    assert result["rows"][0] == result["rows"][1] > 0
    for column, (ours, theirs) in result["types"].items():
        assert SQL_TYPES.get(ours, ours) == theirs, column
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas"):
        assert unwanted not in result["plan"]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_twin(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.count() == 150
    assert "percent_spent" in frame.columns


def plan(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "q15_filter")
    assert "PushedFilters: [IsNotNull(c_acctbal), GreaterThan(c_acctbal,5000.0)]" in text
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string,c_acctbal:double>" in text
    mart = plan(spark, "m3_budget_summary")
    assert "EqualTo(o_orderpriority,1-URGENT)" in mart and "o_orderstatus" not in mart
    assert mart.count("Exchange hashpartitioning") == 1


def test_messages_are_parsed_once(spark):
    for name in ("e2_decode", "e3_route", "e4_result_to_step"):
        assert plan(spark, name).count("from_json(") == 1


def test_pages_are_top_k(spark):
    for name in ("q22_paging", "r4_query_jobs"):
        text = plan(spark, name)
        assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_aggregates_combine_before_the_shuffle(spark):
    for name in ("q11_group_agg", "r3_update_job", "r12_job_summary", "m5_test_unique", "c7_stats"):
        assert "partial_" in plan(spark, name)
