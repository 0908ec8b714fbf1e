"""Activity masks against the plans on activity sets, extended month by month."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from aftershock.functions.calendar import dated
from aftershock.operators import masks
from aftershock.operators.masks import activity_masks, extend_masks
from aftershock.plans import cohorts, masked, monthly
from aftershock.specs import INCIDENT_COHORT, INCIDENT_PHASES, CohortSpec, PhaseSpec, Span
from tests.conftest import order, rows_of
from tests.test_definitions import hostile

CUSTOMER_PLANS = {
    "monthly_active_customer": lambda o: monthly.monthly_active_customer(monthly.customer_base(o)),
    "monthly_customer_activity": monthly.monthly_customer_activity,
    "returning_customer": lambda o: monthly.returning_customer(monthly.monthly_customer_activity(o)),
    "returning_customer_rate": lambda o: monthly.returning_customer_rate(monthly.customer_base(o)),
}
RESTAURANT_PLANS = {
    "monthly_rest_activity": monthly.monthly_rest_activity,
    "monthly_active_res": lambda o: monthly.monthly_active_res(monthly.monthly_rest_activity(o)),
    "churn_restaurants": lambda o: monthly.churn_restaurants(monthly.monthly_rest_activity(o)),
    "restaurant_churn_rate": lambda o: monthly.restaurant_churn_rate(monthly.monthly_rest_activity(o)),
}


def assert_alike(orders, cohort=INCIDENT_COHORT, customers=None):
    if customers is None:
        customers = activity_masks(orders, "customer_id")
    served = activity_masks(orders, "restaurant_id")
    for name, plan in CUSTOMER_PLANS.items():
        assert rows_of(getattr(masked, name)(customers)) == rows_of(plan(orders)), name
    for name, plan in RESTAURANT_PLANS.items():
        assert rows_of(getattr(masked, name)(served)) == rows_of(plan(orders)), name
    any_phase = monthly.restaurant_churn_rate(monthly.monthly_rest_activity(orders), same_phase=False)
    assert rows_of(masked.restaurant_churn_rate(served, same_phase=False)) == rows_of(any_phase)
    curve = masked.cohort_retention_curve(customers, cohort)
    assert rows_of(curve) == rows_of(cohorts.cohort_retention_curve(orders, cohort))


@pytest.mark.parametrize(("seed", "span"), [(1, 48), (2, 1), (3, 2), (4, 5)])
def test_masks_equal_activity_sets(spark, make_star, monkeypatch, seed, span):
    # Short spans put neighbouring months into different rows.
    monkeypatch.setattr(masks, "SPAN", span)
    monkeypatch.setattr(masked, "SPAN", span)
    orders = dated(make_star(**hostile(seed)).fact_orders, INCIDENT_PHASES)
    assert_alike(orders)


def test_cuts_within_a_month_and_many_years(make_star):
    days = ["2023-12-31", "2024-01-01", "2024-02-29", "2025-05-10", "2025-05-20", "2025-06-01", "2031-12-05", "2032-01-09"]
    rows = [order(i, customer=c, restaurant=c and c % 2, at=at) for c in (1, 2, None) for i, at in enumerate(days[c or 0 :])]
    orders = dated(make_star(fact_orders=rows).fact_orders, PhaseSpec(date(2025, 5, 15), date(2025, 5, 25)))
    assert_alike(orders)


def test_masks_are_extended_without_the_old_orders(spark, make_star):
    orders = dated(make_star(**hostile(5)).fact_orders, INCIDENT_PHASES)
    june = F.col("month_start_date") == date(2025, 6, 1)
    late = F.col("order_id") % 7 == 0
    parts = [orders.filter(~june & ~late), orders.filter(june & ~late), orders.filter(late | F.col("order_id").isNull())]
    so_far = activity_masks(parts[0], "customer_id").checkpoint()
    for part in parts[1:]:
        so_far = extend_masks(so_far, part, "customer_id").checkpoint()
    order_by = ["customer_id", "span"]
    assert so_far.orderBy(*order_by).collect() == activity_masks(orders, "customer_id").orderBy(*order_by).collect()
    assert_alike(orders, customers=so_far)


def test_only_counts_are_shuffled_beyond_the_table(spark, make_star, tmp_path):
    orders = dated(make_star(**hostile(6)).fact_orders, INCIDENT_PHASES)
    activity_masks(orders, "restaurant_id").write.parquet(f"{tmp_path}/masks")
    stored = spark.read.parquet(f"{tmp_path}/masks")
    plan = masked.restaurant_churn_rate(stored)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Window" not in plan and "Join" not in plan


def test_odd_inputs(make_star):
    orders = dated(make_star().fact_orders, INCIDENT_PHASES)
    assert activity_masks(orders, "customer_id").count() == 0
    assert masked.cohort_retention_curve(activity_masks(orders, "customer_id"), INCIDENT_COHORT).count() == 0
    window = Span(date(2025, 5, 2), date(2025, 6, 1))
    with pytest.raises(ValueError, match="months"):
        masked.cohort_retention_curve(activity_masks(orders, "customer_id"), CohortSpec("x", window, window, window))
