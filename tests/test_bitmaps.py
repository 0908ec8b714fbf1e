"""Mergeable distinct counts: numbers, bitmaps of days, and the plans on them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from aftershock.functions.calendar import dated
from aftershock.operators.bitmaps import distinct_counts, extend_numbers, merged, numbered, period_bitmaps
from aftershock.plans import counted, monthly, phases, weekly
from aftershock.specs import INCIDENT_PHASES
from tests.conftest import rows_of
from tests.test_definitions import hostile


def test_numbers_are_dense_and_stay(spark):
    frame = spark.createDataFrame([(i % 900,) for i in range(4000)] + [(None,)], "id long").repartition(7)
    numbers = numbered(frame, "id").checkpoint()
    assert sorted(r.number for r in numbers.collect()) == list(range(1, 901))
    more = extend_numbers(numbers, spark.range(800, 1000), "id")
    got = {r.id: r.number for r in more.collect()}
    assert sorted(got.values()) == list(range(1, 1001)) and {r.id: r.number for r in numbers.collect()}.items() <= got.items()
    assert extend_numbers(numbered(frame.limit(0), "id"), frame.limit(0), "id").count() == 0


def test_counts_at_any_grain_are_those_of_the_rows(spark):
    rows = spark.range(200_000).select(
        (F.col("id") % 37).alias("day"),
        F.when(F.col("id") % 11 != 0, F.xxhash64("id") % 70_000).alias("who"),
        (F.col("id") % 3 == 0).alias("odd"),
    )
    numbers = numbered(rows, "who").checkpoint()
    days = period_bitmaps(rows, ["day"], "who", numbers, seen=F.lit(True), odd=F.col("odd")).checkpoint()
    assert days.select("bucket").distinct().count() > 1
    for keys, grain in ((["day"], F.col("day")), (["week"], F.floor(F.col("day") / 7)), (["all"], F.lit(1))):
        got = distinct_counts(days.withColumn(keys[0], grain), keys)
        want = rows.withColumn(keys[0], grain).groupBy(*keys).agg(
            F.countDistinct("who").alias("seen"), F.countDistinct(F.when(F.col("odd"), F.col("who"))).alias("odd")
        )
        assert rows_of(got) == rows_of(want)
    # Merged weeks are as good as days.
    weeks = merged(days.withColumn("week", F.floor(F.col("day") / 7)), ["week"])
    assert rows_of(distinct_counts(weeks.withColumn("all", F.lit(1)), ["all"])) == rows_of(got)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_plans_equal_those_on_orders(spark, make_star, seed):
    star = make_star(**hostile(seed))
    orders = dated(star.fact_orders, INCIDENT_PHASES)
    deliveries, ratings = star.fact_delivery_performance, star.fact_ratings

    def keep(name, frame):
        frame.write.mode("overwrite").saveAsTable(f"store{seed}_{name}")
        return spark.table(f"store{seed}_{name}")

    store = counted.DayStore.of(orders, deliveries, ratings).saved(keep)
    base, direct = counted.monthly_base(store), monthly.monthly_base(orders)
    for plan in (
        monthly.monthly_order,
        monthly.monthly_active_customer,
        monthly.monthly_ordered_active_customer,
        monthly.revenue_per_active_customer,
        monthly.cancellation_rate,
    ):
        assert rows_of(plan(base)) == rows_of(plan(direct)), plan.__name__
    assert rows_of(counted.phase_revenue_decomposition(store)) == rows_of(phases.phase_revenue_decomposition(orders))
    assert rows_of(counted.weekly_kpis(store)) == rows_of(weekly.weekly_kpis(orders, deliveries, ratings))
    # No ids are shuffled any more: the plan reads stored days only.
    plan = counted.weekly_kpis(store)._jdf.queryExecution().optimizedPlan().toString()
    assert "customer_id#" not in plan and "order_id#" not in plan


def test_empty_star(make_star):
    star = make_star()
    store = counted.DayStore.of(dated(star.fact_orders, INCIDENT_PHASES), star.fact_delivery_performance, star.fact_ratings)
    assert counted.monthly_base(store).count() == counted.weekly_kpis(store).count() == 0
