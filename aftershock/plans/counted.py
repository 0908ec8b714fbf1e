"""Customers, frequency and weekly KPIs at any grain from one store of days.

:class:`DayStore` holds additive measures and bitmaps of customers, restaurants and orders by day and
phase. The plans below give the rows of the plans of the same name that read the orders.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aftershock.functions.calendar import MONTH, week_start
from aftershock.functions.measures import MONEY, is_cancelled, is_kept, safe_ratio
from aftershock.operators.bitmaps import distinct_counts, numbered, period_bitmaps
from aftershock.operators.linked import link_days
from aftershock.operators.orders import by_period
from aftershock.plans import weekly

DAY = ["date", "phase"]
KEYS = list(MONTH)


@dataclass(frozen=True)
class DayStore:
    """Frames of a row per day and phase (``measures``, ``links``) or per day, phase and bucket of numbers."""

    measures: DataFrame
    customers: DataFrame
    restaurants: DataFrame
    orders: DataFrame
    links: DataFrame

    @classmethod
    def of(cls, orders: DataFrame, deliveries: DataFrame, ratings: DataFrame) -> DayStore:
        """From dated orders. Ids are shuffled once per kind of id, whatever grains are asked for later."""
        kept_amount = F.sum(F.when(is_kept(), F.col("total_amount"))).cast(MONEY).alias("kept_revenue")
        measures = by_period(orders, DAY).join(orders.groupBy(*DAY).agg(kept_amount), DAY)
        seen, kept, lost = F.lit(True), is_kept(), is_cancelled()
        maps = {}
        for entity, flags in {
            "customer_id": {"seen": seen, "kept": kept},
            "restaurant_id": {"seen": seen, "kept": kept},
            "order_id": {"seen": seen, "kept": kept, "lost": lost},
        }.items():
            maps[entity] = period_bitmaps(orders, DAY, entity, numbered(orders, entity), **flags)
        return cls(
            measures, maps["customer_id"], maps["restaurant_id"], maps["order_id"], link_days(orders, deliveries, ratings)
        )

    def saved(self, save: Callable[[str, DataFrame], DataFrame]) -> DayStore:
        """The store as tables; ``save`` is one of ``pipeline.save_tables``."""
        return DayStore(*[save(f"days_{f.name}", getattr(self, f.name)) for f in fields(self)])


ADDITIVE = ["order_ids", "orders", "kept", "cancelled", "priced"]


def rolled_up(measures: DataFrame, keys: list[str]) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ADDITIVE]
    money = [F.sum(c).cast(MONEY).alias(c) for c in ("revenue", "kept_revenue")]
    return measures.groupBy(*keys).agg(*sums, *money)


def monthly_base(store: DayStore) -> DataFrame:
    """Order and customer measures by month and phase, for the projections of ``plans.monthly``."""
    month = F.trunc("date", "month")
    counts = distinct_counts(store.customers.withColumn(KEYS[0], month), KEYS)
    counts = counts.withColumnsRenamed({"seen": "customers", "kept": "kept_customers"})
    base = rolled_up(store.measures.withColumn(KEYS[0], month), KEYS).join(counts, KEYS, "left")
    return base.fillna(0, ["customers", "kept_customers"])


def phase_revenue_decomposition(store: DayStore) -> DataFrame:
    """Revenue = active customers x frequency x order value, by phase."""
    customers = distinct_counts(store.customers, ["phase"]).select("phase", F.col("kept").alias("active_customers"))
    orders = distinct_counts(store.orders, ["phase"]).select("phase", F.col("kept").alias("non_cancel_orders"))
    base = rolled_up(store.measures, ["phase"]).filter("kept > 0")
    joined = base.join(customers, "phase", "left").join(orders, "phase", "left")
    joined = joined.fillna(0, ["active_customers", "non_cancel_orders"])
    return joined.select(
        "phase",
        "active_customers",
        "non_cancel_orders",
        safe_ratio(F.col("non_cancel_orders"), F.col("active_customers")).alias("frequency"),
        F.col("kept_revenue").alias("revenue"),
        safe_ratio(F.col("kept_revenue"), F.col("non_cancel_orders")).alias("aov"),
    )


def weekly_kpis(store: DayStore) -> DataFrame:
    week = weekly.WEEK
    label = week_start(F.col("date"))
    by_week = [f.withColumn(week[0], label) for f in (store.customers, store.restaurants, store.orders)]
    customers, restaurants, orders = (distinct_counts(f, week) for f in by_week)
    links = weekly.by_week(store.links).groupBy(*week).agg(*[F.sum(c).alias(c) for c in weekly.LINKED])
    # Every week with orders, those of unknown customers only as well.
    weeks = weekly.by_week(store.measures).select(*week).distinct()
    joined = (
        weeks.join(customers.select(*week, F.col("seen").alias("weekly_active_customer")), week, "left")
        .join(restaurants.select(*week, F.col("seen").alias("weekly_active_restaurant")), week, "left")
        .join(orders.select(*week, F.col("seen").alias("weekly_order"), F.col("lost").alias("weekly_cancel_order")), week, "left")
        .join(links, week, "left")
    )
    return weekly.kpis_of(joined.fillna(0, ["weekly_active_customer", "weekly_active_restaurant"]))
