"""Every registered query with SQL, against DuckDB on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_check import compare, duck  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, con, name):
    assert compare(queries()[name](spark, sf), con, SQL[name]) == ""


def test_entry_and_registry(spark):
    assert entry(spark).count() == 11
    assert set(SQL) <= set(queries()) and len(queries()) > 140


def test_scan_plan_is_pruned(spark, sf):
    """Two columns asked, two columns read, and the row-id page is a pushed filter."""
    from tablescope.operators.ordering import with_row_id
    from tablescope.operators.rows import page
    from tablescope.operators.target import class_feasibility

    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    plan = class_feasibility(lines, ["l_returnflag"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_returnflag:string>" in plan
    numbered = with_row_id(lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey", "l_linenumber", "l_partkey"])
    plan = page(numbered, 10, 5)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
