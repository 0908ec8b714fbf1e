"""The daily mart and the customer-day frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aftershock.functions.calendar import assign_phase
from aftershock.functions.measures import MONEY, is_kept, safe_ratio
from aftershock.operators.linked import delivery_measures, linked_measures, rating_measures
from aftershock.operators.orders import average_order_value, with_customers
from aftershock.specs import PhaseSpec


def by_day(orders: DataFrame) -> DataFrame:
    """Orders with their day; the sub-marts below keep undated orders as a group of their own."""
    return orders.withColumn("date", F.to_date("order_timestamp"))


def daily_orders(orders: DataFrame) -> DataFrame:
    return with_customers(by_day(orders), ["date"]).select(
        "date",
        F.col("orders").alias("total_orders"),
        F.col("kept").alias("non_cancel_orders"),
        F.col("revenue").alias("revenue_non_cancel"),
        average_order_value().alias("aov_non_cancel"),
        F.col("kept_customers").alias("active_customers_non_cancel"),
        F.col("cancelled").alias("cancelled_orders"),
        safe_ratio(F.col("cancelled"), F.col("orders")).alias("cancellation_rate"),
    )


def daily_ratings(orders: DataFrame, ratings: DataFrame) -> DataFrame:
    """Ratings by the day of the rated order."""
    measures = rating_measures(by_day(orders), ratings, ["date"])
    return measures.select("date", "avg_rating", "rating_count", "low_rating_rate")


def daily_delivery(orders: DataFrame, deliveries: DataFrame) -> DataFrame:
    measures = delivery_measures(by_day(orders).filter(is_kept()), deliveries, ["date"])
    return measures.select("date", "avg_expected_time_min", "avg_actual_time_min", "late_rate")


def daily_summary(
    orders: DataFrame, deliveries: DataFrame, ratings: DataFrame, phases: PhaseSpec
) -> DataFrame:
    linked = linked_measures(orders, deliveries, ratings, ["date"], delivered=is_kept())
    return daily_from(orders, linked, phases)


def daily_from(orders: DataFrame, linked: DataFrame, phases: PhaseSpec) -> DataFrame:
    """One row per day with orders; all branches are partitioned alike by the day.

    Takes dated orders and their linked measures by day. The calendar holds exactly the days with orders, so the order branch is the spine.
    Revenue is zero where no amount is known; ratings and deliveries stay NULL.
    """
    days = daily_orders(orders).withColumn("phase", assign_phase(F.col("date"), phases))
    return days.join(linked, "date", "left").select(
        "date",
        "phase",
        "total_orders",
        "non_cancel_orders",
        F.coalesce("revenue_non_cancel", F.lit(0).cast(MONEY)).alias("revenue_non_cancel"),
        "aov_non_cancel",
        "active_customers_non_cancel",
        "cancellation_rate",
        "avg_rating",
        "rating_count",
        "low_rating_rate",
        "avg_expected_time_min",
        "avg_actual_time_min",
        "late_rate",
    )


def orders_per_active_customer_day(daily: DataFrame) -> DataFrame:
    """Kept orders per active customer-day, by phase."""
    orders = F.sum(F.col("non_cancel_orders").cast("double"))
    customer_days = F.sum(F.col("active_customers_non_cancel").cast("double"))
    return daily.groupBy("phase").agg(
        safe_ratio(orders, customer_days).alias("orders_per_active_customer")
    )
