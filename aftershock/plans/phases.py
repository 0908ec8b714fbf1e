"""Phase-level diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aftershock.functions.calendar import assign_phase, before, phase_rank
from aftershock.functions.measures import (
    MONEY,
    count_when,
    decimal_ratio,
    is_kept,
    safe_ratio,
    weighted_mean,
)
from aftershock.operators.orders import by_period, customers_by_period
from aftershock.specs import PhaseSpec


def phase_revenue_decomposition(orders: DataFrame) -> DataFrame:
    """Revenue = active customers x frequency x order value, by phase.

    Revenue, customers and order ids are taken in a pass each: one aggregate with two
    distinct counts would carry every order several times through its hash tables.
    """
    kept = orders.filter(is_kept())
    revenue = by_period(kept, ["phase"]).select("phase", "revenue")
    customers = customers_by_period(kept, ["phase"])
    ids = kept.select("phase", "order_id").distinct()
    counted = ids.groupBy("phase").agg(F.count("order_id").alias("non_cancel_orders"))
    return revenue.join(customers, "phase", "left").join(counted, "phase", "left").select(
        "phase",
        F.col("customers").alias("active_customers"),
        "non_cancel_orders",
        safe_ratio(F.col("non_cancel_orders"), F.col("customers")).alias("frequency"),
        "revenue",
        safe_ratio(F.col("revenue"), F.col("non_cancel_orders")).alias("aov"),
    )


def phase_customer_overlap(orders: DataFrame, phases: PhaseSpec) -> DataFrame:
    """How many 'pre' customers never ordered in the crisis; cancelled orders count too.

    One row per customer says in which phases they ordered, instead of joining two
    customer sets. The unknown customer never matches, hence counts as missing.
    """
    per_customer = (
        orders.filter(before(F.col("order_timestamp"), phases.post_start))
        .groupBy("customer_id")
        .agg(
            F.max(F.col("phase") == "pre").alias("in_pre"),
            F.max(F.col("phase") == "crisis").alias("in_crisis"),
        )
    )
    seen_again = F.col("in_crisis") & F.col("customer_id").isNotNull()
    total, common = F.count(F.lit(1)), count_when(seen_again)
    missing = total - common
    return (
        per_customer.filter("in_pre")
        .agg(
            total.alias("pre_customer_total"),
            F.when(total > 0, missing).alias("pre_never_ordered_in_crisis"),
            decimal_ratio(missing * 100, total, "decimal(10,2)").alias("pct_pre_missing_in_crisis"),
            F.when(total > 0, common).alias("customer_pre_and_crisis"),
        )
    )


def new_vs_returning(orders: DataFrame, phases: PhaseSpec) -> DataFrame:
    """Customers ordering on their first day, and on any later day, by phase.

    A customer's first and last order day within each phase decide both questions, so no
    order has to be joined to its customer's first day. Takes undated orders too: they
    form a group without phase and are never a first order.
    """
    day = F.to_date("order_timestamp")
    spans = (
        orders.filter(is_kept())
        .select("customer_id", day.alias("date"), assign_phase(day, phases).alias("phase"))
        .groupBy("customer_id", "phase")
        .agg(F.min("date").alias("first"), F.max("date").alias("last"))
    )
    # At most one row per phase for any customer.
    debut = F.min("first").over(Window.partitionBy("customer_id"))
    known = F.when(F.col("customer_id").isNotNull(), 1)
    is_new = F.col("first") == F.col("debut")
    is_back = F.coalesce(F.col("last") > F.col("debut"), F.lit(True))
    return (
        spans.withColumn("debut", debut)
        .groupBy("phase")
        .agg(
            F.count(F.when(is_new, known)).alias("new_customer"),
            F.count(F.when(is_back, known)).alias("returning_customer"),
        )
    )


def phase_comparison(master: DataFrame) -> DataFrame:
    """The monthly master rolled up to phases: totals, typical months, weighted rates."""
    deliveries = F.col("deliveries")
    actual, expected = F.col("avg_actual_time_min"), F.col("avg_expected_time_min")
    gap = F.sum(actual * deliveries) - F.sum(expected * deliveries)
    rows = master.groupBy("phase").agg(
        F.count(F.lit(1)).alias("months_in_phase"),
        F.sum("total_orders").alias("total_orders"),
        F.sum("total_revenue").cast(MONEY).alias("total_revenue"),
        _whole_average("active_customer").alias("avg_monthly_active_customers"),
        _whole_average("active_customer_non_cancel").alias("avg_monthly_active_non_cancel_customers"),
        weighted_mean(F.col("retention_rate"), F.col("active_customer")).alias("retention_rate"),
        weighted_mean(F.col("avg_rating"), F.col("total_rating")).alias("avg_rating"),
        weighted_mean(F.col("late_rate"), deliveries).alias("late_rate"),
        weighted_mean(actual, deliveries).alias("avg_actual_time_min"),
        weighted_mean(expected, deliveries).alias("avg_expected_time_min"),
        safe_ratio(gap, F.sum(deliveries)).alias("diff_actual_expected_min"),
        safe_ratio(F.sum("total_cancelled_order"), F.sum("total_orders")).alias("cancellation_rate"),
        _whole_average("active_restaurants").alias("avg_monthly_active_restaurants"),
        F.avg("avg_sentiment").alias("avg_monthly_sentiment_score"),
    )
    return rows.orderBy(phase_rank(F.col("phase")))


def _whole_average(column: str):
    """Integer average: the fraction is cut off, as for an integer column in the source."""
    return F.avg(column).cast("bigint")
