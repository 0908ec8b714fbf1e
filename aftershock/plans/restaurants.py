"""Restaurant revenue tiers and the restaurants that led before the crisis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aftershock.functions.calendar import before, phase_rank
from aftershock.functions.measures import MONEY, count_when, is_kept
from aftershock.operators.ntile import tier_by_ntile, tier_rank
from aftershock.specs import PHASES, PhaseSpec


def amount() -> Column:
    return F.coalesce(F.col("total_amount"), F.lit(0).cast("decimal(18,4)"))


def best_first() -> list[Column]:
    """By 'pre' revenue; equal revenue by id, which makes the order total."""
    return [F.desc("pre_revenue"), F.asc_nulls_first("restaurant_id")]


def restaurant_phases(orders: DataFrame) -> DataFrame:
    """Kept orders and revenue of each phase side by side, one row per restaurant."""
    measures: list[Column] = []
    for phase in PHASES:
        hit = F.col("phase") == phase
        measures.append(count_when(hit).alias(f"{phase}_orders"))
        measures.append(F.sum(F.when(hit, amount())).cast(MONEY).alias(f"{phase}_revenue"))
    return orders.filter(is_kept()).groupBy("restaurant_id").agg(*measures)


def _phase_rows(wide: DataFrame, *keep: str) -> DataFrame:
    """Back to one row per phase, without the phases that saw no orders."""
    entries = [
        F.struct(
            F.lit(phase).alias("phase"),
            F.col(f"{phase}_orders").alias("orders"),
            F.col(f"{phase}_revenue").alias("revenue"),
        )
        for phase in PHASES
    ]
    return wide.select(*keep, F.inline(F.array(*entries))).filter(F.col("orders") > 0)


def restaurant_tier_by_phase(orders: DataFrame) -> DataFrame:
    """Orders and revenue by tier of 'pre' revenue and phase.

    The unknown restaurant is ranked with the others, but its orders cannot be looked up
    by id: its tier gets a row without phase, orders and revenue.
    """
    ranked = tier_by_ntile(restaurant_phases(orders).filter(F.col("pre_orders") > 0), best_first())
    totals = [c for c in ranked.columns if c.endswith(("_orders", "_revenue"))]
    tiers = ranked.groupBy(
        "restaurant_tier", F.col("restaurant_id").isNull().alias("unknown")
    ).agg(*[F.sum(c).alias(c) for c in totals])
    rows = _phase_rows(tiers.filter(~F.col("unknown")), "restaurant_tier")
    unmatched = tiers.filter("unknown").select(
        "restaurant_tier",
        F.lit(None).cast("string").alias("phase"),
        F.lit(None).cast("bigint").alias("orders"),
        F.lit(None).cast(MONEY).alias("revenue"),
    )
    return rows.unionByName(unmatched).orderBy(
        tier_rank(F.col("restaurant_tier")), phase_rank(F.col("phase"))
    )


def top_restaurants_pre(
    orders: DataFrame, restaurants: DataFrame, phases: PhaseSpec, n: int = 15
) -> DataFrame:
    """The ``n`` restaurants with the highest 'pre' revenue.

    The limit applies before the dimension join, so an unknown restaurant can take a place.
    """
    pre = orders.filter(is_kept() & before(F.col("order_timestamp"), phases.crisis_start))
    revenue = pre.groupBy("restaurant_id").agg(
        F.count(F.lit(1)).alias("pre_orders"), F.sum(amount()).cast(MONEY).alias("pre_revenue")
    )
    return _named(revenue.orderBy(*best_first()).limit(n), restaurants).select(
        "restaurant_id", "restaurant_name", "city", "pre_orders", "pre_revenue"
    ).orderBy(*best_first())


def top_restaurants_across_phases(
    orders: DataFrame, restaurants: DataFrame, n: int = 15
) -> DataFrame:
    """Orders and revenue in every phase of the ``n`` leaders of 'pre'.

    One pass over the orders holds all phases per restaurant, so the leaders bring their
    later phases along.
    """
    leaders = restaurant_phases(orders).filter(F.col("pre_orders") > 0).orderBy(*best_first()).limit(n)
    named = _named(leaders, restaurants)
    rows = _phase_rows(named, "restaurant_id", "restaurant_name", "city", "pre_revenue")
    ordered = rows.orderBy(*best_first(), phase_rank(F.col("phase")))
    return ordered.select("restaurant_id", "restaurant_name", "city", "phase", "orders", "revenue")


def _named(leaders: DataFrame, restaurants: DataFrame) -> DataFrame:
    """Attach names; the leaders are broadcast, as their number is a parameter."""
    names = restaurants.select("restaurant_id", "restaurant_name", "city")
    return names.join(F.broadcast(leaders), "restaurant_id")
