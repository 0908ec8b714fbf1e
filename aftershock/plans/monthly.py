"""Monthly marts, one row per month and phase unless said otherwise.

Bases turn the facts into a row per month and phase; marts are projections of a base, so a
base that was stored once serves all its marts. What a mart leaves out of a lazy base,
Catalyst prunes. Orders come from :func:`aftershock.functions.calendar.dated`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aftershock.functions.calendar import MONTH
from aftershock.functions.measures import count_when, decimal_ratio, is_kept, safe_ratio
from aftershock.operators.activity import active_set, flag_churned, in_adjacent_month, returning
from aftershock.operators.dimension import join_dimension
from aftershock.operators.linked import delivery_measures, linked_measures, measures_of_days, rating_measures
from aftershock.operators.orders import (
    average_order_value,
    by_period,
    count_customers,
    period_customers,
)
from aftershock.specs import PhaseSpec

KEYS = list(MONTH)
DELIVERY_KPIS = [
    "deliveries",
    "avg_expected_time_min",
    "avg_actual_time_min",
    "diff_minutes_decimal",
    "late_rate",
]


def order_base(orders: DataFrame) -> DataFrame:
    """Additive order measures."""
    return by_period(orders, KEYS)


def customer_base(orders: DataFrame) -> DataFrame:
    """Active customers, buyers, and buyers who also bought in the month before."""
    back = in_adjacent_month(F.col("bought"), ["customer_id"], -1)
    per_customer = period_customers(orders, KEYS).withColumn("back", back)
    came_back = F.when(F.col("bought") & F.col("back"), F.col("customer_id"))
    return count_customers(per_customer, KEYS, F.count(came_back).alias("returning_customers"))


def monthly_base(orders: DataFrame) -> DataFrame:
    """Order and customer measures; both sides of the join are partitioned alike."""
    return order_base(orders).join(customer_base(orders), KEYS, "left")


def link_base(orders: DataFrame, deliveries: DataFrame, ratings: DataFrame) -> DataFrame:
    """KPIs of the deliveries of kept orders, and of the ratings of all orders."""
    return linked_measures(orders, deliveries, ratings, KEYS, delivered=is_kept())


def link_base_of_days(days: DataFrame) -> DataFrame:
    """:func:`link_base` from stored sums by day."""
    return measures_of_days(days.withColumn("month_start_date", F.trunc("date", "month")), KEYS)


def monthly_order(base: DataFrame) -> DataFrame:
    return base.select(
        *KEYS,
        F.col("order_ids").alias("total_orders"),
        F.col("revenue").alias("total_revenue"),
        average_order_value().alias("average_order_value"),
        F.col("cancelled").alias("total_cancelled_order"),
        F.col("kept").alias("total_non_cancelled_order"),
    )


def monthly_active_customer(base: DataFrame) -> DataFrame:
    return base.select(
        *KEYS,
        F.col("customers").alias("active_customer"),
        F.col("kept_customers").alias("active_customer_non_cancel"),
    )


def cancellation_rate(base: DataFrame) -> DataFrame:
    share = safe_ratio(F.col("cancelled"), F.col("orders"))
    percent = safe_ratio(F.lit(100.0) * F.col("cancelled").cast("double"), F.col("orders"))
    return base.select(
        *KEYS,
        F.col("orders").alias("total_orders"),
        F.col("cancelled").alias("cancelled_orders"),
        share.alias("cancellation_rate"),
        F.round(percent, 3).alias("cancellation_rate_pct"),
    )


def monthly_ordered_active_customer(base: DataFrame) -> DataFrame:
    return base.select(
        *KEYS,
        F.col("kept").alias("total_noncancel_order"),
        F.col("kept_customers").alias("active_customer"),
        safe_ratio(F.col("kept"), F.col("kept_customers")).alias("order_per_active_customer"),
    )


def revenue_per_active_customer(base: DataFrame) -> DataFrame:
    per_customer = decimal_ratio(F.col("revenue"), F.col("kept_customers"), "decimal(18,4)")
    return base.select(
        *KEYS,
        F.col("kept_customers").alias("active_customer_non_cancel"),
        F.col("revenue").alias("total_revenue_non_cancel"),
        per_customer.alias("revenue_per_active_customer"),
    )


def returning_customer_rate(base: DataFrame) -> DataFrame:
    return base.select(
        *KEYS,
        F.col("kept_customers").alias("active_customers"),
        "returning_customers",
        safe_ratio(F.col("returning_customers"), F.col("kept_customers")).alias("retention_rate"),
    )


def delivery_performance_summary(orders: DataFrame, deliveries: DataFrame) -> DataFrame:
    return delivery_measures(orders.filter(is_kept()), deliveries, KEYS)


def rating_summary(orders: DataFrame, ratings: DataFrame) -> DataFrame:
    """Ratings by order month, those of cancelled orders included."""
    return rating_measures(orders, ratings, KEYS).drop("rating_count")


def delivery_mart(links: DataFrame) -> DataFrame:
    """The delivery mart from the stored links; only months with deliveries."""
    return links.filter(F.col("deliveries").isNotNull()).select(*KEYS, *DELIVERY_KPIS)


def rating_mart(links: DataFrame) -> DataFrame:
    """The rating mart from the stored links; only months with ratings."""
    return links.filter(F.col("rating_count").isNotNull()).drop("rating_count", *DELIVERY_KPIS)


def monthly_customer_activity(orders: DataFrame) -> DataFrame:
    return active_set(orders, "customer_id")


def returning_customer(activity: DataFrame) -> DataFrame:
    """Customers of a month who also ordered in the month before, whatever its phase.

    Takes the customer activity, freshly derived or read back from its table.
    """
    back = returning(activity, "customer_id")
    return back.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("returning_customers"))


def monthly_rest_activity(orders: DataFrame) -> DataFrame:
    return active_set(orders, "restaurant_id").withColumnRenamed(
        "restaurant_id", "non_cancel_rest_id"
    )


def monthly_active_res(activity: DataFrame) -> DataFrame:
    active = F.count("non_cancel_rest_id").alias("active_restaurants")
    return activity.groupBy(*KEYS).agg(active)


def restaurant_activity_summary(activity: DataFrame, restaurants: DataFrame) -> DataFrame:
    """Active restaurants by month, phase and partner type.

    The activity has one row per restaurant and month when it meets the dimension, so a
    restaurant's order volume does not matter to the join. A restaurant with several dimension
    rows counts once per partner type.
    """
    is_active = F.col("is_active")
    attributes = restaurants.groupBy("restaurant_id", "partner_type").agg(
        F.max(is_active == 1).alias("some_active"), F.max(is_active == 0).alias("some_inactive")
    )
    active = activity.withColumnRenamed("non_cancel_rest_id", "restaurant_id")
    return (
        join_dimension(active, attributes, "restaurant_id")
        .groupBy(*KEYS, "partner_type")
        .agg(
            F.count(F.lit(1)).alias("monthly_active_restaurant"),
            count_when(F.col("some_active")).alias("active_restaurant_with_orders"),
            count_when(F.col("some_inactive")).alias("inactive_restaurant_with_ordes"),
        )
    )


def restaurant_base(activity: DataFrame, same_phase: bool = True) -> DataFrame:
    """Active restaurants of a month and those gone in the next, in one pass over the activity.

    ``gone`` also counts the unknown restaurant, which churns but has no id to count.
    """
    restaurant = F.col("non_cancel_rest_id")
    flagged = flag_churned(activity, "non_cancel_rest_id", same_phase)
    return flagged.groupBy(*KEYS).agg(
        F.count(restaurant).alias("active_restaurants"),
        F.count(F.when(F.col("churned"), restaurant)).alias("churned_restaurants"),
        count_when(F.col("churned")).alias("gone"),
    )


def restaurant_churn_rate(activity: DataFrame, same_phase: bool = True) -> DataFrame:
    """Churn reported in the month after the last activity, under that activity's phase.

    Takes the restaurant activity. The previous-month base is the activity group the
    churned restaurants come from, so both sides of the rate are columns of one row.
    """
    return churn_rate_of(restaurant_base(activity, same_phase))


def churn_rate_of(base: DataFrame) -> DataFrame:
    """:func:`restaurant_churn_rate` from active, churned and gone restaurants by month and phase."""
    return base.filter(F.col("gone") > 0).select(
        F.add_months("month_start_date", 1).alias("month_start_date"),
        "phase",
        "churned_restaurants",
        F.col("active_restaurants").alias("active_restaurants_prev_month"),
        safe_ratio(F.col("churned_restaurants"), F.col("active_restaurants")).alias("churn_rate"),
    )


def churn_restaurants(activity: DataFrame, same_phase: bool = True) -> DataFrame:
    return restaurant_churn_rate(activity, same_phase).select(*KEYS, "churned_restaurants")


def restaurants_by_month(activity: DataFrame) -> DataFrame:
    """Active restaurants and incoming churn side by side, one row per month.

    Each activity group yields a row for its own month and one for the next, where its
    churn is reported; adding them up per month replaces two joins.
    """
    nothing = F.lit(None).cast("bigint")
    own = F.struct(
        F.col("month_start_date"),
        F.col("active_restaurants"),
        nothing.alias("churned_restaurants"),
        nothing.alias("active_restaurants_prev_month"),
    )
    following = F.struct(
        F.add_months("month_start_date", 1).alias("month_start_date"),
        nothing.alias("active_restaurants"),
        F.when(F.col("gone") > 0, F.col("churned_restaurants")).alias("churned_restaurants"),
        F.when(F.col("gone") > 0, F.col("active_restaurants")).alias("active_restaurants_prev_month"),
    )
    rows = restaurant_base(activity).select(F.inline(F.array(own, following)))
    churned, before = F.sum("churned_restaurants"), F.sum("active_restaurants_prev_month")
    return rows.groupBy("month_start_date").agg(
        F.sum("active_restaurants").alias("active_restaurants"),
        safe_ratio(churned, before).alias("restaurant_churn_rate"),
        churned.alias("churned_restaurants"),
        before.alias("active_restaurants_prev_month"),
    )


def monthly_master_summary(
    orders: DataFrame, deliveries: DataFrame, ratings: DataFrame, phases: PhaseSpec
) -> DataFrame:
    """All monthly marts in one row per month, 33 columns.

    Four branches: order measures, customers, orders linked to deliveries and ratings, and
    restaurants. Each is one pass over the orders and reads its own columns.
    """
    return master_from(
        monthly_base(orders),
        link_base(orders, deliveries, ratings),
        restaurants_by_month(monthly_rest_activity(orders)),
        phases,
    )


def master_from(
    base: DataFrame, links: DataFrame, restaurants: DataFrame, phases: PhaseSpec
) -> DataFrame:
    """The master from its bases, lazy or stored.

    The bases end in aggregates on the month and phase, so the joins find their sides
    partitioned alike; only the restaurants, which are keyed by month alone, move again, with
    a row per month.
    """
    phases.require_month_starts()
    joined = base.join(links, KEYS, "left").join(restaurants, "month_start_date", "left")
    cancelled, all_orders = F.col("cancelled"), F.col("orders")
    percent = safe_ratio(F.lit(100.0) * cancelled.cast("double"), all_orders)
    return joined.select(
        *KEYS,
        F.col("order_ids").alias("total_orders"),
        F.col("revenue").alias("total_revenue"),
        average_order_value().alias("average_order_value"),
        cancelled.alias("total_cancelled_order"),
        F.col("kept").alias("total_non_cancelled_order"),
        F.col("customers").alias("active_customer"),
        F.col("kept_customers").alias("active_customer_non_cancel"),
        F.col("kept_customers").alias("active_customers"),
        "returning_customers",
        safe_ratio(F.col("returning_customers"), F.col("kept_customers")).alias("retention_rate"),
        "deliveries",
        "avg_expected_time_min",
        "avg_actual_time_min",
        "diff_minutes_decimal",
        "late_rate",
        "avg_rating",
        "total_rating",
        "low_rating_rate",
        "five_start_rating",
        "one_start_rating",
        "net_rating",
        "avg_sentiment",
        cancelled.alias("cancelled_orders"),
        safe_ratio(cancelled, all_orders).alias("cancellation_rate"),
        F.round(percent, 3).alias("cancellation_rate_pct"),
        safe_ratio(F.col("kept"), F.col("kept_customers")).alias("order_per_active_customer"),
        decimal_ratio(F.col("revenue"), F.col("kept_customers"), "decimal(18,4)").alias(
            "revenue_per_active_customer"
        ),
        "active_restaurants",
        "restaurant_churn_rate",
        "churned_restaurants",
        "active_restaurants_prev_month",
    )
