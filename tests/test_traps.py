"""Hand-computed results for the semantic traps of FIXTURES.md §4."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from aftershock.functions.calendar import dated, week_start
from aftershock.functions.measures import rate, safe_ratio, weighted_mean
from aftershock.operators import calendar, quality
from aftershock.operators.ntile import global_ntile
from aftershock.plans import cities, cohorts, daily, monthly, phases, weekly
from aftershock.specs import INCIDENT_COHORT, INCIDENT_PHASES, CohortSpec, PhaseSpec, Span
from tests.conftest import day, delivery, order, rating, restaurant, rows_of

PHASES = INCIDENT_PHASES


def orders_of(star):
    return dated(star.fact_orders, PHASES)


def test_flags_compare_without_case_or_trailing_blanks(make_star):
    flags = ["N", "n", "Y", "y", "N "]
    star = make_star(fact_orders=[order(i, flag=f) for i, f in enumerate(flags)])
    got = rows_of(monthly.monthly_order(monthly.order_base(orders_of(star))), "total_non_cancelled_order", "total_cancelled_order")
    assert got == [(3, 2)]


def test_undated_order_has_no_calendar_row(make_star):
    star = make_star(fact_orders=[order(1), order(2, at=None)])
    assert rows_of(calendar.build_dim_date(star.fact_orders, PHASES), "date") == [(day("2025-05-10"),)]
    assert calendar.orders_with_date(star.fact_orders, PHASES).count() == 1


def test_weeks_run_sunday_to_saturday(spark):
    days = ["2025-05-31", "2025-06-01", "2025-06-02", "2025-06-29", "2025-07-01"]
    frame = spark.createDataFrame([(d,) for d in days], "d string")
    got = frame.select(week_start(F.to_date("d")).alias("w")).collect()
    assert [str(r.w) for r in got] == ["2025-05-26", "2025-06-02", "2025-06-02", "2025-06-30", "2025-06-30"]


def test_calendar_attributes(make_star):
    star = make_star(fact_orders=[order(1, at="2025-06-01 23:59:59")])
    row = calendar.build_dim_date(star.fact_orders, PHASES).collect()[0]
    assert tuple(row) == (
        day("2025-06-01"), 20250601, 2025, 6, "June", day("2025-06-01"), "2025-06", 1, "Sunday", 1, "crisis",
    )


def test_integer_averages_are_cut_off(make_star):
    orders = [order(1, 1, at="2025-03-05"), order(2, 1, at="2025-04-05"), order(3, 2, at="2025-04-06")]
    orders += [order(4, 1, at="2025-05-05"), order(5, 2, at="2025-05-06")]
    star = make_star(fact_orders=orders)
    master = monthly.monthly_master_summary(
        orders_of(star), star.fact_delivery_performance, star.fact_ratings, PHASES
    )
    row = phases.phase_comparison(master).collect()[0]
    assert (row.months_in_phase, row.avg_monthly_active_customers) == (3, 1)
    assert row.late_rate is None and row.avg_monthly_sentiment_score is None


def test_no_pre_customers_gives_null_not_an_error(make_star):
    star = make_star(fact_orders=[order(1, at="2025-06-10")])
    row = phases.phase_customer_overlap(orders_of(star), PHASES).collect()[0]
    assert tuple(row) == (0, None, None, None)


def test_unrated_row_counts_in_rates_only(make_star):
    star = make_star(
        fact_orders=[order(1), order(2), order(3)],
        fact_ratings=[rating(1, 1.0), rating(2, None), rating(3, 5.0)],
    )
    row = monthly.rating_summary(orders_of(star), star.fact_ratings).collect()[0]
    assert (row.total_rating, row.avg_rating) == (2, 3.0)
    assert row.low_rating_rate == row.five_start_rating == row.one_start_rating == pytest.approx(1 / 3)
    assert row.net_rating == 0.0


def test_every_restaurant_churns_at_a_phase_cut(make_star):
    star = make_star(fact_orders=[order(i, at=f"2025-0{i}-10") for i in (5, 6, 7)])
    got = rows_of(monthly.restaurant_churn_rate(monthly.monthly_rest_activity(orders_of(star))))
    assert got == [
        (day("2025-06-01"), "pre", 1, 1, 1.0),
        (day("2025-07-01"), "crisis", 1, 1, 1.0),
        (day("2025-08-01"), "post", 1, 1, 1.0),
    ]
    across = monthly.churn_restaurants(monthly.monthly_rest_activity(orders_of(star)), same_phase=False)
    assert rows_of(across) == [(day("2025-08-01"), "post", 1)]


def test_week_with_a_cut_repeats_its_rating(make_star):
    star = make_star(
        fact_orders=[order(1, at="2025-06-30"), order(2, at="2025-07-01")],
        fact_ratings=[rating(1, 2.0), rating(2, 4.0)],
    )
    kpis = weekly.weekly_kpis(orders_of(star), star.fact_delivery_performance, star.fact_ratings)
    got = rows_of(kpis, "week_start_date", "phase", "weekly_order", "avg_weekly_rating")
    assert got == [(day("2025-06-30"), "crisis", 1, 3.0), (day("2025-06-30"), "post", 1, 3.0)]
    spans = rows_of(weekly.phase_spans(kpis))
    assert spans == [("crisis", day("2025-06-30"), day("2025-06-30")), ("post", day("2025-06-30"), day("2025-06-30"))]


def test_ntile_ties_go_by_id(spark):
    frame = spark.createDataFrame([(i, 5) for i in range(11)], "id int, revenue int").repartition(5)
    tiles = global_ntile(frame, [F.desc("revenue"), F.asc("id")], 10)
    assert [r.tile for r in tiles.orderBy("id").collect()] == [1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]


def test_cents_are_rounded_order_by_order(make_star):
    star = make_star(
        fact_orders=[order(1, amount="0.0050"), order(2, amount="0.0050"), order(3, restaurant=2, amount="1")],
        dim_restaurant=[restaurant(1, prep="18"), restaurant(2, city="Agra", prep="n/a")],
    )
    orders = orders_of(star)
    got = rows_of(cities.city_revenue(orders, star.dim_restaurant), "city", "revenue", "avg_prep_time_active_restaurants")
    assert got == [("Agra", Decimal("1.00"), None), ("Pune", Decimal("0.02"), 18.0)]
    exact = rows_of(cities.city_phase(orders, star.dim_restaurant), "city", "revenue")
    assert exact == [("Agra", Decimal("1.0000")), ("Pune", Decimal("0.0100"))]


def test_several_deliveries_and_ratings_of_one_order(make_star):
    spec = INCIDENT_COHORT
    star = make_star(
        fact_orders=[order(1, at="2025-05-10"), order(2, at="2025-06-10")],
        fact_delivery_performance=[delivery(2, 30, 50), delivery(2, 30, 30)],
        fact_ratings=[rating(2, 1.0), rating(2, 5.0)],
    )
    orders = orders_of(star)
    ops = rows_of(cohorts.cohort_ops_retention(orders, star.fact_delivery_performance, spec))
    assert ops == [("may_2025", 1, 0, 1, 0, 0.0)]
    low = rows_of(
        cohorts.cohort_rating_retention(orders, star.fact_delivery_performance, star.fact_ratings, spec)
    )
    assert low == [(1, 1, 0, 0.0, 1.0)]
    summary = monthly.delivery_performance_summary(orders, star.fact_delivery_performance)
    assert rows_of(summary, "deliveries", "diff_minutes_decimal", "late_rate") == [(2, 10.0, 0.5)]


def test_only_empty_ratings_are_dropped(make_star):
    empty = rating(None, None, None, None, None)
    partial = rating(None, 4.0, None, None, None)
    star = make_star(fact_ratings=[empty, partial, rating(1, 5.0)])
    assert quality.clean_ratings(star.fact_ratings).count() == 2
    audit = dict(rows_of(quality.null_key_audit(star)))
    assert (audit["fact_ratings"], audit["clean_fact_ratings"], audit["fact_orders"]) == (2, 1, 0)


def test_returning_customers(make_star):
    star = make_star(
        fact_orders=[order(1, 1, at="2025-05-05"), order(2, 1, at="2025-06-05"), order(3, 2, at="2025-05-06"), order(4, 3, at="2025-06-06")]
    )
    orders = orders_of(star)
    assert rows_of(monthly.returning_customer(monthly.monthly_customer_activity(orders))) == [(day("2025-06-01"), "crisis", 1)]
    assert rows_of(monthly.returning_customer_rate(monthly.customer_base(orders))) == [
        (day("2025-05-01"), "pre", 2, 0, 0.0),
        (day("2025-06-01"), "crisis", 2, 1, 0.5),
    ]


def test_new_customer_can_return_within_the_phase(make_star):
    star = make_star(
        fact_orders=[order(1, at="2025-05-01"), order(2, at="2025-05-01 18:00:00"), order(3, at="2025-05-02")]
    )
    assert rows_of(phases.new_vs_returning(star.fact_orders, PHASES)) == [("pre", 1, 1)]


def test_revenue_identity(make_star):
    orders = [order(i, customer=i % 3, at=f"2025-0{5 + i % 3}-1{i % 9}", amount=f"{i}.25") for i in range(1, 30)]
    star = make_star(fact_orders=orders)
    for row in phases.phase_revenue_decomposition(orders_of(star)).collect():
        assert row.active_customers * row.frequency * row.aov == pytest.approx(float(row.revenue))


def test_frequency_per_customer_day(make_star):
    star = make_star(fact_orders=[order(1), order(2), order(3, customer=2), order(4, customer=3, flag="Y")])
    summary = daily.daily_summary(orders_of(star), star.fact_delivery_performance, star.fact_ratings, PHASES)
    row = summary.collect()[0]
    assert (row.total_orders, row.non_cancel_orders, row.active_customers_non_cancel) == (4, 3, 2)
    assert row.rating_count is None and row.late_rate is None
    assert rows_of(daily.orders_per_active_customer_day(summary)) == [("pre", 1.5)]


def test_retention_curve(make_star):
    star = make_star(
        fact_orders=[
            order(1, 1, at="2025-05-03"), order(2, 2, at="2025-05-04"), order(3, None, at="2025-05-05"),
            order(4, 1, at="2025-06-05"), order(5, 9, at="2025-06-06"), order(6, None, at="2025-06-07"),
            order(7, 1, at="2025-07-05"), order(8, 2, at="2025-07-05"), order(9, 9, at="2025-08-01"),
        ]
    )
    got = rows_of(cohorts.cohort_retention_curve(orders_of(star), INCIDENT_COHORT))
    assert got == [
        (day("2025-06-01"), 1, 1, 3, pytest.approx(1 / 3)),
        (day("2025-07-01"), 2, 2, 3, pytest.approx(2 / 3)),
        (day("2025-08-01"), 3, 0, 3, 0.0),
    ]


def test_measure_expressions(spark):
    frame = spark.createDataFrame([(1.0, 1), (4.0, 3), (None, 5)], "x double, w int")
    row = frame.agg(rate(F.col("x") > 2), weighted_mean(F.col("x"), F.col("w")), safe_ratio(F.sum("w"), F.lit(0))).collect()[0]
    assert tuple(row) == (pytest.approx(1 / 3), pytest.approx(13 / 9), None)


def test_specs_reject_bad_ranges():
    with pytest.raises(ValueError):
        PhaseSpec(day("2025-07-01"), day("2025-06-01"))
    with pytest.raises(ValueError):
        Span(day("2025-07-01"), day("2025-07-01"))
    with pytest.raises(ValueError):
        PhaseSpec(day("2025-06-15"), day("2025-07-01")).require_month_starts()
    with pytest.raises(ValueError):
        spec = CohortSpec("x", INCIDENT_COHORT.cohort, INCIDENT_COHORT.experience, INCIDENT_COHORT.outcome)
        cohorts.cohort_rating_retention(None, None, None, spec, group_by=("no_such_flag",))
