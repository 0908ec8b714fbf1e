"""Weekly KPIs and their index against the 'pre' phase."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aftershock.functions.calendar import week_start
from aftershock.functions.measures import count_when, is_cancelled, safe_ratio
from aftershock.operators.linked import (
    DELIVERY_SUMS,
    RATING_SUMS,
    delivery_columns,
    linked_orders,
    rating_columns,
)

WEEK = ["week_start_date", "phase"]
LINKED = DELIVERY_SUMS + RATING_SUMS


def weekly_kpis(orders: DataFrame, deliveries: DataFrame, ratings: DataFrame) -> DataFrame:
    weekly = by_week(orders)
    return weekly_from(weekly, _weekly_links(weekly, deliveries, ratings))


def weekly_of_days(orders: DataFrame, days: DataFrame) -> DataFrame:
    """The KPIs from stored sums by day (``operators.linked.link_days``); orders are counted only."""
    weekly = by_week(orders)
    sums = by_week(days).groupBy(*WEEK).agg(*[F.sum(c).alias(c) for c in LINKED])
    return weekly_from(weekly, _weekly_orders(weekly).join(sums, WEEK, "left"))


def by_week(frame: DataFrame) -> DataFrame:
    return frame.withColumn("week_start_date", week_start(F.col("date")))


def weekly_from(weekly: DataFrame, links: DataFrame) -> DataFrame:
    """Order KPIs by week and phase, rating and delivery means by week.

    A week with a phase cut yields a row per phase, with the same rating and delivery
    values. Customers and restaurants are counted in a pass each: every pass reads its own
    id column only, and both combine well on the map side, which they would not in one
    hash table together with the order ids. The left joins let Catalyst drop a pass whose
    columns are not asked for.
    """
    joined = (
        _distinct(weekly, "customer_id", "weekly_active_customer")
        .join(_distinct(weekly, "restaurant_id", "weekly_active_restaurant"), WEEK, "left")
        .join(links, WEEK, "left")
    )
    return kpis_of(joined)


def kpis_of(joined: DataFrame) -> DataFrame:
    """The KPIs from a row per week and phase with the distinct counts and the sums of ``LINKED``."""
    # One row per phase of a week; measures of the other phases count for the whole week.
    week = Window.partitionBy("week_start_date")
    whole_week = joined.withColumns({c: F.sum(c).over(week) for c in LINKED})
    return (
        whole_week.select("*", *delivery_columns(), *rating_columns())
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("weekly_order", "weekly_cancel_order")})
        .select(
            "phase",
            "week_start_date",
            "weekly_order",
            "weekly_active_customer",
            "weekly_cancel_order",
            "weekly_active_restaurant",
            safe_ratio(F.col("weekly_order"), F.col("weekly_active_customer")).alias("weekly_frequency"),
            safe_ratio(F.col("weekly_cancel_order"), F.col("weekly_order")).alias("cancellation_rate"),
            F.col("avg_rating").alias("avg_weekly_rating"),
            F.col("avg_actual_time_min").alias("avg_weekly_actual_time"),
            F.col("avg_expected_time_min").alias("avg_weekly_expected_time"),
            (F.col("avg_actual_time_min") - F.col("avg_expected_time_min")).alias("avg_weekly_delay_min"),
        )
    )


def _weekly_links(weekly: DataFrame, deliveries: DataFrame, ratings: DataFrame) -> DataFrame:
    """Distinct orders and the sums of their deliveries and ratings, by week and phase.

    The linked orders are already partitioned by id, so counting distinct ids shuffles
    nothing more than one row per week and phase.
    """
    marked = weekly.withColumn("lost", is_cancelled())
    linked = linked_orders(marked, [*WEEK, "lost"], deliveries, ratings)
    per_order = linked.groupBy(*WEEK, "order_id").agg(
        F.max("lost").alias("lost"), *[F.sum(F.col(c) * F.col("orders")).alias(c) for c in LINKED]
    )
    return per_order.groupBy(*WEEK).agg(
        F.count("order_id").alias("weekly_order"),
        count_when(F.col("lost")).alias("weekly_cancel_order"),
        *[F.sum(c).alias(c) for c in LINKED],
    )


def _weekly_orders(weekly: DataFrame) -> DataFrame:
    """Distinct orders, and those of them that were cancelled."""
    known = weekly.filter(F.col("order_id").isNotNull())
    per_order = known.groupBy(*WEEK, "order_id").agg(F.max(is_cancelled()).alias("lost"))
    return per_order.groupBy(*WEEK).agg(
        F.count("order_id").alias("weekly_order"), count_when(F.col("lost")).alias("weekly_cancel_order")
    )


def _distinct(weekly: DataFrame, entity: str, name: str) -> DataFrame:
    seen = weekly.select(*WEEK, entity).distinct()
    return seen.groupBy(*WEEK).agg(F.count(entity).alias(name))


# Index name and the weekly metric it tracks.
INDEXES = {
    "orders_index": "weekly_order",
    "customers_index": "weekly_active_customer",
    "delay_index": "avg_weekly_delay_min",
    "rating_index": "avg_weekly_rating",
    "cancel_index": "cancellation_rate",
}


def baseline_index(weekly: DataFrame, phase: str = "pre") -> DataFrame:
    """Each metric as a percentage of its mean over the weeks of ``phase``.

    The baseline is a window over the whole frame, which has a row per calendar week and
    phase at any data volume. A join with the one-row baseline would run the weekly
    aggregation twice.
    """
    whole = Window.partitionBy()
    in_phase = F.col("phase") == phase
    indexes = {
        index: safe_ratio(F.col(metric), F.avg(F.when(in_phase, F.col(metric))).over(whole)) * 100
        for index, metric in INDEXES.items()
    }
    return weekly.withColumns(indexes)


def phase_spans(weekly: DataFrame) -> DataFrame:
    """First and last week of each phase."""
    return weekly.groupBy("phase").agg(
        F.min("week_start_date").alias("first_week"), F.max("week_start_date").alias("last_week")
    )
