"""City KPIs by phase, their revenue shares, and pivots for reporting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aftershock.functions.calendar import phase_rank
from aftershock.functions.measures import MONEY, decimal_ratio, is_kept, safe_ratio
from aftershock.operators.dimension import fits_broadcast, join_dimension
from aftershock.specs import PHASES

GRAIN = ["city", "phase"]


def prep_minutes(bucket: Column) -> Column:
    """Midpoint of a preparation-time label; other text is read as a number or NULL."""
    # Label midpoints in minutes.
    return (
        F.when(bucket == "0-15", 7.5)
        .when(bucket == "16-25", 20.5)
        .when(bucket == "26-40", 33.0)
        .when(bucket == ">40", 45.0)
        .otherwise(bucket.try_cast("double"))
    )


def city_base(orders: DataFrame, restaurants: DataFrame) -> DataFrame:
    """All city measures, one row per city and phase.

    Additive measures and restaurants are reduced to one row per restaurant and phase
    before the dimension join. Only the customers need a join at order volume; there a
    restaurant that owns much of the orders is spread over tasks by customer. Both parts
    meet in one final aggregate, which also keeps an unknown city.
    """
    kept = orders.filter(is_kept())
    zero = F.lit(0).cast("decimal(18,4)")
    cents = F.coalesce(F.col("total_amount").try_cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))
    per_restaurant = kept.groupBy("restaurant_id", "phase").agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum(F.coalesce("total_amount", zero)).cast(MONEY).alias("revenue"),
        F.sum(cents).cast("decimal(38,2)").alias("revenue_cents"),
    )
    active = F.col("is_active") == 1
    minutes = F.when(active, prep_minutes(F.col("avg_prep_time_min")))
    # A restaurant can have several rows: its orders count once per row, it counts once per city.
    attributes = restaurants.groupBy("restaurant_id", "city").agg(
        F.count(F.lit(1)).alias("entries"),
        F.max(F.when(active, 1)).alias("partners"),
        F.sum(minutes).alias("minutes"),
        F.count(minutes).alias("timed"),
    )
    volume = join_dimension(per_restaurant, attributes, "restaurant_id").select(
        *GRAIN,
        (F.col("orders") * F.col("entries")).alias("orders"),
        (F.col("revenue") * F.col("entries")).cast(MONEY).alias("revenue"),
        (F.col("revenue_cents") * F.col("entries")).cast("decimal(38,2)").alias("revenue_cents"),
        F.lit(1).alias("restaurants"),
        "partners",
        (F.col("minutes") * F.col("orders")).alias("prep_sum"),
        F.when(F.col("timed") > 0, F.col("orders") * F.col("timed")).alias("prep_n"),
    )
    customers = visitors(kept, restaurants).select(*GRAIN, "customer_id").distinct()
    parts = volume.unionByName(customers, allowMissingColumns=True)
    return parts.groupBy(*GRAIN).agg(
        F.sum("orders").alias("orders"),
        F.sum("revenue").cast(MONEY).alias("revenue"),
        F.sum("revenue_cents").cast("decimal(18,2)").alias("revenue_cents"),
        F.count("customer_id").alias("active_customers"),
        F.count("restaurants").alias("active_restaurants"),
        F.count("partners").alias("active_partner_restaurants"),
        safe_ratio(F.sum("prep_sum"), F.sum("prep_n")).alias("avg_prep_time_active_restaurants"),
    )


def visitors(kept: DataFrame, restaurants: DataFrame) -> DataFrame:
    """Customers of kept orders with the city of the restaurant.

    Where the dimension is too big to broadcast, a customer comes once per restaurant and
    phase, so that one who owns many orders, the unknown one above all, is a single row.
    """
    visits = kept.select("restaurant_id", "phase", "customer_id")
    places = restaurants.select("restaurant_id", "city")
    if not fits_broadcast(places):
        visits = visits.distinct()
    return join_dimension(visits, places, "restaurant_id", spread_by=F.col("customer_id"))


def city_phase(orders: DataFrame, restaurants: DataFrame) -> DataFrame:
    return (
        city_base(orders, restaurants)
        .select(*GRAIN, "orders", "revenue", "active_customers", "active_restaurants")
        .orderBy("city", phase_rank(F.col("phase")))
    )


def city_revenue(orders: DataFrame, restaurants: DataFrame) -> DataFrame:
    """City KPIs with frequency, order value and share of the phase's revenue.

    Revenue is rounded to cents order by order here, unlike in :func:`city_phase`. The
    phase total is a window over one row per city.
    """
    base = city_base(orders, restaurants)
    revenue = F.col("revenue_cents")
    total = F.sum(revenue).over(Window.partitionBy("phase"))
    share = revenue.cast("decimal(20,2)") / F.nullif(total.cast("decimal(20,2)"), F.lit(0).cast("decimal(20,2)"))
    return base.select(
        *GRAIN,
        "orders",
        revenue.alias("revenue"),
        "active_customers",
        "active_restaurants",
        "active_partner_restaurants",
        "avg_prep_time_active_restaurants",
        decimal_ratio(F.col("orders"), F.col("active_customers"), "decimal(10,4)").alias("frequency"),
        decimal_ratio(revenue, F.col("orders"), "decimal(10,2)").alias("aov"),
        share.cast("decimal(10,6)").alias("revenue_share_in_phase"),
    )


def pivot_phase(frame: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """One row per key, columns ``<phase>_<metric>`` (one metric: ``<phase>``), phases in order."""
    values = [F.max(metric).alias(metric) for metric in metrics]
    return frame.groupBy(key).pivot("phase", list(PHASES)).agg(*values)


def city_revenue_wide(orders: DataFrame, restaurants: DataFrame) -> DataFrame:
    """One row per city: four metrics for each phase, and revenue ratios between phases."""
    metrics = ["revenue", "orders", "active_customers", "active_restaurants"]
    wide = pivot_phase(city_base(orders, restaurants), "city", metrics)
    pre, crisis, post = (F.col(f"{phase}_revenue") for phase in PHASES)
    return wide.select(
        "city",
        *[f"{phase}_{metric}" for metric in metrics for phase in PHASES],
        safe_ratio(crisis, pre).alias("crisis_vs_pre_revenue_pct"),
        safe_ratio(post, pre).alias("post_vs_pre_revenue_pct"),
        safe_ratio(post, crisis).alias("post_vs_crisis_revenue_multiple"),
    ).orderBy(F.desc("pre_revenue"), "city")


def restaurant_coverage(city: DataFrame) -> DataFrame:
    """Active restaurants by city and phase, with 'post' as a percentage of 'pre'."""
    wide = pivot_phase(city, "city", ["active_restaurants"])
    percent = safe_ratio(F.col("post"), F.col("pre")) * 100
    return wide.withColumn("post_vs_pre_pct", percent).orderBy(F.desc_nulls_last("pre"), "city")


def revenue_share_pivot(city: DataFrame) -> DataFrame:
    """Share of each phase's revenue, one row per city."""
    return pivot_phase(city, "city", ["revenue_share_in_phase"]).orderBy("city")
