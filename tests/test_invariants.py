"""Relations between marts, and the fixture numbers measured on the driver tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from aftershock.sources.tpch import read_star

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return entry.Tables(read_star(spark, DATA))


@pytest.fixture(scope="module")
def run(tables):
    cache = {}

    def get(name):
        if name not in cache:
            cache[name] = entry.PLANS[name](tables).collect()
        return cache[name]

    return get


def test_row_counts(tables):
    star = tables.star
    assert star.fact_orders.count() == 15000
    assert star.fact_orders.filter("restaurant_id IS NULL").count() == 257
    assert star.fact_delivery_performance.count() == 14743
    assert star.dim_restaurant.count() == 100
    assert star.dim_restaurant.select("city").distinct().count() == 25


def test_late_deliveries(tables):
    delay = F.col("actual_delivery_time_mins") - F.col("expected_delivery_time_mins")
    row = tables.deliveries.agg(F.avg((delay > 0).cast("int")), F.avg((delay > 15).cast("int"))).collect()[0]
    assert [round(v, 3) for v in row] == [0.810, 0.331]


def test_cohort_groups(run):
    ops = {(r.high_delay_flag, r.cancelled_flag): (r.total_customers, r.retained_customers) for r in run("q33_cohort_ops_retention")}
    assert ops == {(0, 0): (528, 270), (0, 1): (87, 50), (1, 0): (87, 51), (1, 1): (94, 58)}
    low = {r.low_rating_flag: (r.customers, r.retained_count) for r in run("q34_cohort_rating_retention")}
    assert low == {0: (502, 206), 1: (77, 33)}
    buckets = {r.frequency_bucket: r.customer for r in run("q36_frequency_bucket_retention")}
    assert buckets == {"1_order": 436, "2_order": 114, "3+_order": 29}


def test_overlap(run):
    row = run("q31_phase_customer_overlap")[0]
    assert (row.pre_customer_total, row.pre_never_ordered_in_crisis) == (1480, 345)
    assert row.customer_pre_and_crisis + row.pre_never_ordered_in_crisis == row.pre_customer_total


def test_weeks_in_two_phases(run):
    weeks = [str(r.week_start_date) for r in run("q32_weekly_kpis")]
    assert len(weeks) == 346
    assert {w for w in weeks if weeks.count(w) == 2} == {"1997-12-29", "1998-12-28"}


def test_boundary_churn(run):
    churn = {(str(r.month_start_date), r.phase): (r.churned_restaurants, r.active_restaurants_prev_month) for r in run("q23_restaurant_churn_rate")}
    assert churn[("1998-01-01", "pre")] == (52, 52) and churn[("1999-01-01", "crisis")] == (55, 55)


def test_flags_split_the_orders(run):
    for row in run("q08_monthly_order"):
        assert row.total_cancelled_order + row.total_non_cancelled_order == row.total_orders


def test_returning_and_churned_are_bounded(run):
    for row in run("q19_returning_customer_rate"):
        assert row.returning_customers <= row.active_customers
    for row in run("q23_restaurant_churn_rate"):
        assert row.churned_restaurants <= row.active_restaurants_prev_month


def test_shares_add_up(run):
    rows = run("q41_city_revenue")
    for phase in ("pre", "crisis", "post"):
        shares = [r.revenue_share_in_phase for r in rows if r.phase == phase]
        assert abs(sum(shares) - 1) <= len(shares) * 1e-6


def test_revenue_identity(run):
    for row in run("q30_phase_revenue_decomposition"):
        assert row.active_customers * row.frequency * row.aov == pytest.approx(float(row.revenue))


def test_index_baseline_is_100(run):
    rows = [r for r in run("q44_baseline_index") if r.phase == "pre"]
    for index in ("orders_index", "customers_index", "delay_index", "rating_index", "cancel_index"):
        values = [r[index] for r in rows if r[index] is not None]
        assert sum(values) / len(values) == pytest.approx(100)


def test_master_has_one_row_per_month(run):
    assert run("q24_grain_check") == []
    assert run("q27_mart_row_count")[0].rows_in_master == len(run("q08_monthly_order")) == 80


def test_first_curve_month_matches_the_outcome_logic(run):
    rows = run("q49_cohort_retention_curve")
    assert [r.months_after_cohort for r in sorted(rows, key=lambda r: r.month_start_date)] == list(range(1, len(rows) + 1))
    assert {r.cohort_size for r in rows} == {528 + 87 + 87 + 94}
