"""The physical plans the marts are designed for."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import SparkSession

import __spark_entry__ as entry
from aftershock.sources.tpch import read_star

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def plan(spark):
    """Text of the physical plan as for big tables: nothing is broadcast by default."""

    def text(name: str) -> str:
        frame = entry.PLANS[name](entry.Tables(read_star(spark, DATA)))
        return frame._jdf.queryExecution().executedPlan().toString()

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield text
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


LAZY = [n for n in entry.PLANS if n not in ("q48_export_csv", "q37_restaurant_tier_by_phase", "q03_amounts_of_changed_type")]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins_and_no_python(plan, name):
    text = plan(name)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "BatchEvalPython", "ArrowEvalPython", "Expand"):
        assert operator not in text


@pytest.mark.parametrize(
    "name,columns",
    [
        ("q08_monthly_order", "o_orderkey,o_orderstatus,o_totalprice,o_orderdate"),
        ("q09_monthly_active_customer", "o_custkey,o_orderstatus,o_orderdate"),
        ("q13_cancellation_rate", "o_orderstatus,o_orderdate"),
        ("q19_returning_customer_rate", "o_custkey,o_orderstatus,o_orderdate"),
        ("q45_phase_spans", "o_custkey,o_orderdate"),
    ],
)
def test_scans_read_the_needed_columns_of_the_orders_only(plan, name, columns):
    text = plan(name)
    read = re.findall(r"FileScan parquet \[([^\]]*)\]", text)
    assert len(read) == 1
    got = re.sub(r"#\d+L?", "", read[0])
    assert set(got.split(",")) <= set(columns.split(","))


def test_master_reads_the_orders_once_per_branch(plan):
    assert plan("q26_monthly_master_summary").count("FileScan parquet [o_") == 4


def test_distinct_customers_take_two_shuffles(plan):
    assert plan("q09_monthly_active_customer").count("Exchange") == 2


def test_cohort_is_one_shuffle_on_the_customer(plan):
    text = plan("q36_frequency_bucket_retention")
    assert text.count("Exchange hashpartitioning(customer_id") == 1 and "Join" not in text


def test_joined_branches_are_partitioned_alike(plan):
    """No exchange directly below the joins on month and phase."""
    text = plan("q28_daily_summary")
    assert text.count("SortMergeJoin [date") == 1
    assert "Sort [date#" in text and not re.search(r"Sort \[date#[^\n]*\n[^\n]*Exchange", text)


def test_top_k_does_not_sort_everything(plan):
    for name in ("q38_top_restaurants_pre", "q39_top_restaurants_across_phases", "q17_preview"):
        assert "TakeOrderedAndProject" in plan(name)


def test_phase_becomes_a_timestamp_filter(plan):
    assert "LessThan(o_orderdate,1998-01-01" in full("q38_top_restaurants_pre")
    assert "GreaterThanOrEqual(o_orderdate,1997-07-01" in full("q36_frequency_bucket_retention")


def full(name: str) -> str:
    spark = SparkSession.getActiveSession()
    frame = entry.PLANS[name](entry.Tables(read_star(spark, DATA)))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return frame._jdf.queryExecution().explainString(mode)


def test_dimension_is_broadcast_by_its_size(plan):
    text = plan("q40_city_phase")
    assert len(re.findall(r"BroadcastHashJoin \[restaurant_id#", text)) == 2


def test_null_audit_pushes_the_null_filter(plan):
    assert "IsNull(o_orderkey)" in full("q01_null_key_audit")
