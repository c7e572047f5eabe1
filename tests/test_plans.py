"""Shapes of physical plans."""

from __future__ import annotations

import contextlib
import io
import re

import pytest

import __spark_entry__ as contract
from conftest import DATA
from stallwise.operators import keyed
from stallwise.plans import binding
from stallwise.plans.registry import REGISTER, Tables
from stallwise.operators.clean import above_by_sql, trailing

FOLDER = f"{DATA}/sf0.001"
# These queries run jobs while they are built; their plans only read the result back.
BATCH = sorted(name for name in REGISTER if not name.startswith("st_"))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _formatted(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", BATCH)
def test_no_python_no_cross_join_no_single_task_window(name, spark):
    plan = _plan(contract.queries()[name](spark, FOLDER))
    for node in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if re.search(r"\bWindow \[", line):
            assert not any("SinglePartition" in below for below in lines[i + 1 : i + 4])


def test_window_filter_reaches_the_scan(spark):
    rows = trailing(binding.valid_lines(Tables(spark, FOLDER)), binding.AS_OF, 7)
    plan = _formatted(rows.select("point_id", "amount"))
    pushed = re.search(r"PushedFilters: \[(.*)\]", plan).group(1)
    assert "GreaterThan(l_shipdate" in pushed and "LessThanOrEqual(l_shipdate" in pushed
    assert "LessThan(l_extendedprice" in pushed
    assert "l_orderkey" not in plan


def test_key_and_range_reads_reach_the_scan(spark):
    table = Tables(spark, FOLDER).customer
    assert "EqualTo(c_name" in _formatted(keyed.get_row(table, "c_name", "x"))
    assert "GreaterThanOrEqual(c_name" in _formatted(keyed.scan(table, "c_name", "a", "b"))
    assert "StringStartsWith(c_name" in _formatted(keyed.scan_any(table, "c_name", "a", "b", prefix="x"))
    assert "TakeOrderedAndProject" in _plan(keyed.scan_top(table, "c_name", "a", "b", 5))
    assert "TakeOrderedAndProject" in _plan(contract.queries()["search_page"](spark, FOLDER))


def test_sql_predicate_is_pushed(spark):
    plan = _formatted(above_by_sql(Tables(spark, FOLDER).orders, "o_totalprice", 3.0).select("o_orderkey"))
    assert "GreaterThan(o_totalprice,3.0)" in plan
    assert "o_orderdate" not in plan


def test_facts_are_aggregated_before_the_join(spark):
    """Right above every scan of the order lines stands an aggregate, not a join."""
    for name in ("site_daily_sales", "site_tiers", "site_cv", "per_machine_sales", "point_fact"):
        plan = _plan(contract.queries()[name](spark, FOLDER)).splitlines()
        for i, line in enumerate(plan):
            if "l_suppkey" in line and "FileScan" in line:
                assert any("HashAggregate" in above for above in plan[max(0, i - 4) : i]), name


TENURED = (
    "site_daily_sales", "point_band_counts", "site_tiers", "site_tiers_short", "site_cv", "star_lookup", "cohort_rows",
    "idle_sites", "stats_feeds_joined", "per_machine_sales", "point_fact",
)


@pytest.mark.parametrize("name", TENURED)
def test_no_query_of_a_window_scans_the_whole_history(name, spark):
    plan = _formatted(contract.queries()[name](spark, FOLDER))
    scans = [s for s in plan.split("\n\n") if "Scan parquet" in s and "lineitem.parquet" in s]
    assert scans
    for scan in scans:
        assert re.search(r"PushedFilters: \[.*GreaterThan\w*\(l_shipdate", scan), scan


def test_shared_scans(spark):
    plan = _formatted(contract.queries()["star_lookup"](spark, FOLDER))
    assert len([s for s in plan.split("\n\n") if "Scan parquet" in s and "lineitem.parquet" in s]) <= 3
