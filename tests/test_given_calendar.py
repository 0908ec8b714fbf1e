"""Marts on a stored calendar that somebody has edited."""

from __future__ import annotations

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from aftershock.functions.calendar import dated
from aftershock.operators import dimension
from aftershock.operators.calendar import build_dim_date, dated_by
from aftershock.plans import monthly, phases, weekly
from aftershock.sinks.write import save_mart
from aftershock.sources.star import read_star
from aftershock.specs import INCIDENT_PHASES, PhaseSpec
from tests.conftest import arrow, order, rows_of, star_of
from tests.test_definitions import hostile

MOVED = PhaseSpec(date(2025, 5, 20), date(2025, 7, 9))


@pytest.mark.parametrize("broadcast", [True, False])
def test_moved_phases_equal_a_derived_calendar(spark, make_star, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(dimension, "BROADCAST_BYTES", 0)
    star = make_star(**hostile(5))
    calendar = save_mart(build_dim_date(star.fact_orders, MOVED), f"moved_{broadcast}".lower())
    given, derived = dated_by(star.fact_orders, calendar), dated(star.fact_orders, MOVED)
    assert rows_of(given, *derived.columns) == rows_of(derived)
    assert rows_of(monthly.monthly_order(monthly.order_base(given))) == rows_of(monthly.monthly_order(monthly.order_base(derived)))
    satellites = star.fact_delivery_performance, star.fact_ratings
    assert rows_of(weekly.weekly_kpis(given, *satellites)) == rows_of(weekly.weekly_kpis(derived, *satellites))


def test_edited_days(spark, make_star):
    star = make_star(fact_orders=[order(i, at=f"2025-05-{i:02d}") for i in range(1, 21)] + [order(50, at=None)])
    calendar = build_dim_date(star.fact_orders, INCIDENT_PHASES)
    day = F.dayofmonth("date")
    calendar = calendar.withColumn("phase", F.when(day.between(5, 8), "strike").otherwise(F.col("phase")))
    calendar = calendar.withColumn("holiday", day == 1).filter(day != 20)
    got = dated_by(star.fact_orders, calendar, "holiday")
    assert rows_of(got.groupBy("phase", "holiday").count()) == rows_of(
        spark.createDataFrame([("pre", True, 1), ("pre", False, 14), ("strike", False, 4)], "phase string, holiday boolean, count long")
    )
    assert {r.phase for r in phases.phase_revenue_decomposition(got).collect()} == {"pre", "strike"}


def test_a_calendar_of_one_phase_reads_its_range_of_the_orders(spark, tmp_path):
    rows = hostile(2)
    star_of(spark, arrow(**rows)).fact_orders.write.parquet(f"{tmp_path}/fact_orders")
    orders = read_star(spark, str(tmp_path), normalized=True).fact_orders
    calendar = build_dim_date(orders, INCIDENT_PHASES).filter("phase = 'crisis'")
    got = dated_by(orders, calendar)
    plan = got._jdf.queryExecution().executedPlan().toString()
    pushed = re.findall(r"PushedFilters: \[([^\]]*)", plan)
    assert any("GreaterThanOrEqual(order_timestamp,2025-06" in p and "LessThan(" in p for p in pushed), pushed
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning(date" not in plan.split("BroadcastHashJoin")[0]
    assert rows_of(got) == rows_of(dated(orders, INCIDENT_PHASES).filter("phase = 'crisis'"), *got.columns)


def test_odd_calendars(make_star):
    star = make_star(fact_orders=[order(1), order(2)])
    calendar = build_dim_date(star.fact_orders, INCIDENT_PHASES)
    assert dated_by(star.fact_orders, calendar.limit(0)).count() == 0
    with pytest.raises(ValueError, match="2 rows for 1 days"):
        dated_by(star.fact_orders, calendar.unionByName(calendar))
