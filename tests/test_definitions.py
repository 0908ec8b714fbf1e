"""All plans against the DuckDB definitions: on the driver tables and on hostile random stars."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from aftershock.specs import INCIDENT_COHORT, INCIDENT_PHASES, PhaseSpec
from checks.compare import duck, duck_digest, duck_rows, spark_digest, spark_rows
from checks.oracle import statements
from tests.conftest import arrow, delivery, order, rating, restaurant, star_of

SMALL = "/root/testdata/sf0.001"
MONTH_MARTS = {"q24_grain_check", "q26_monthly_master_summary", "q27_mart_row_count", "q27_mart_dump", "q43_phase_comparison"}


@pytest.fixture(scope="module")
def small():
    return duck(SMALL)


@pytest.mark.parametrize("name", [*entry.PLANS, *entry.BUILDS])
def test_driver_tables(spark, small, name):
    frame = entry.queries()[name](spark, SMALL)
    assert spark_rows(frame) == duck_rows(small, entry.oracle_sql()[name])


@pytest.mark.parametrize("name", ["q02_clean_ratings", "q03_normalize_amounts", "q07_orders_with_date", "q16_monthly_customer_activity"])
def test_digests_of_large_frames(spark, small, name):
    frame = entry.queries()[name](spark, SMALL)
    digest = spark_digest(frame)
    assert digest == duck_digest(small, entry.oracle_sql()[name]) and digest[0] == frame.count() > 0
    assert spark_digest(frame.limit(digest[0] - 1)) != digest


# Column order of the stored marts and the phase report.
COLUMNS = {
    "q04_build_dim_date": "date date_key year month month_name month_start_date year_month day_of_week day_name"
    " is_weekend phase",
    "q26_monthly_master_summary": "month_start_date phase total_orders total_revenue average_order_value"
    " total_cancelled_order total_non_cancelled_order active_customer active_customer_non_cancel active_customers"
    " returning_customers retention_rate deliveries avg_expected_time_min avg_actual_time_min diff_minutes_decimal"
    " late_rate avg_rating total_rating low_rating_rate five_start_rating one_start_rating net_rating avg_sentiment"
    " cancelled_orders cancellation_rate cancellation_rate_pct order_per_active_customer"
    " revenue_per_active_customer active_restaurants restaurant_churn_rate churned_restaurants"
    " active_restaurants_prev_month",
    "q28_daily_summary": "date phase total_orders non_cancel_orders revenue_non_cancel aov_non_cancel"
    " active_customers_non_cancel cancellation_rate avg_rating rating_count low_rating_rate avg_expected_time_min"
    " avg_actual_time_min late_rate",
    "q43_phase_comparison": "phase months_in_phase total_orders total_revenue avg_monthly_active_customers"
    " avg_monthly_active_non_cancel_customers retention_rate avg_rating late_rate avg_actual_time_min"
    " avg_expected_time_min diff_actual_expected_min cancellation_rate avg_monthly_active_restaurants"
    " avg_monthly_sentiment_score",
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_column_order(spark, name):
    assert entry.queries()[name](spark, SMALL).columns == COLUMNS[name].split()


def test_entry_is_the_master(spark):
    frame = entry.entry(spark)
    assert len(frame.columns) == 33 and frame.count() == 80


def hostile(seed: int) -> dict:
    """A small star with everything that goes wrong in real tables.

    Unknown customers, restaurants, days, amounts and flags; repeated order ids; ids without
    a dimension row or with several; several deliveries and ratings per order, some for no order; equal
    revenues; and one customer, one restaurant and one order that own a third of their rows.
    """
    rnd = random.Random(seed)
    maybe = lambda value, p=0.06: None if rnd.random() < p else value
    first = datetime(2025, 2, 25)
    orders = []
    for i in range(rnd.choice([60, 400])):
        at = first + timedelta(minutes=rnd.randrange(60 * 24 * 190))
        orders.append(
            order(
                order_id=maybe(rnd.randrange(i) if i and rnd.random() < 0.05 else i, 0.03),
                customer=maybe(7 if rnd.random() < 0.33 else rnd.randrange(40)),
                restaurant=maybe(3 if rnd.random() < 0.33 else rnd.randrange(24)),
                at=maybe(at.isoformat(sep=" "), 0.03),
                amount=maybe(str(Decimal(rnd.choice([0, 5, 1250, 99999, rnd.randrange(10**6)])) / 10000)),
                flag=maybe(rnd.choice(["N", "n", "N ", "N", "Y", "y"]), 0.04),
            )
        )
    hot = rnd.randrange(len(orders))
    pick = lambda: maybe(hot if rnd.random() < 0.33 else rnd.randrange(len(orders) + 20))
    return {
        "fact_orders": orders,
        "fact_order_items": [
            {"order_id": maybe(rnd.randrange(30)), "menu_item_id": maybe(rnd.randrange(4))} for _ in range(90)
        ],
        "fact_delivery_performance": [
            delivery(pick(), maybe(rnd.randrange(20, 40)), maybe(rnd.randrange(15, 70))) for _ in range(500)
        ],
        "fact_ratings": [
            rating(pick(), maybe(float(rnd.randrange(1, 6))), maybe(rnd.randrange(21) / 20), maybe(rnd.randrange(40)))
            for _ in range(300)
        ]
        + [rating(None, None, None, None, None)] * 3,
        "dim_restaurant": [
            restaurant(
                i,
                city=maybe(rnd.choice(["Pune", "Agra", "Goa"])),
                partner=maybe(rnd.choice(["cloud", "dine-in"])),
                active=maybe(rnd.randrange(2)),
                prep=maybe(rnd.choice(["0-15", "16-25", "26-40", ">40", "18", "n/a", ""])),
            )
            for i in [*range(20), *(rnd.randrange(20) for _ in range(4))]
        ]
        + [restaurant(3, city="Goa", partner="cloud", active=1, prep="18")] * 2,
    }


def definitions(rows: dict) -> duckdb.DuckDBPyConnection:
    """A DuckDB with the base tables; flags as a case-insensitive column compares them."""
    con = duckdb.connect()
    for name, table in arrow(**rows).items():
        con.register(f"raw_{name}", table)
        fields = "* REPLACE (UPPER(RTRIM(is_cancelled)) AS is_cancelled)" if name == "fact_orders" else "*"
        con.execute(f"CREATE TABLE {name} AS SELECT {fields} FROM raw_{name}")
    return con


def check(spark, rows: dict, phases, names) -> None:
    con = definitions(rows)
    context = entry.Tables(star_of(spark, arrow(**rows)), phases, INCIDENT_COHORT)
    expected = statements(phases, INCIDENT_COHORT, base="")
    wrong = [n for n in names if spark_rows(entry.PLANS[n](context)) != duck_rows(con, expected[n])]
    assert wrong == []


# The others store files and have tests of their own.
RANDOM_PLANS = [n for n in entry.PLANS if n not in ("q48_export_csv", "q03_amounts_of_changed_type") and "given" not in n]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hostile_star(spark, seed):
    check(spark, hostile(seed), INCIDENT_PHASES, RANDOM_PLANS)


def test_cuts_within_a_month(spark):
    cuts = PhaseSpec(date(2025, 5, 14), date(2025, 6, 20))
    check(spark, hostile(4), cuts, [n for n in RANDOM_PLANS if n not in MONTH_MARTS])


def test_empty_star(spark):
    check(spark, {}, INCIDENT_PHASES, RANDOM_PLANS)
