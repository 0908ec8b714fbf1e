"""The whole build: clean, calendar, monthly marts, master, daily mart, reports.

``save`` stores a mart under its name and returns the stored frame, so later steps read
tables instead of computing their inputs again. Saving overwrites, so a run can be repeated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aftershock.functions.calendar import dated, phase_rank
from aftershock.operators.calendar import build_dim_date
from aftershock.operators import quality
from aftershock.operators.linked import link_days, measures_of_days
from aftershock.operators.quality import clean_ratings
from aftershock.plans import cities, cohorts, daily, monthly, phases, restaurants, weekly
from aftershock.sinks.write import save_mart
from aftershock.sources.star import Star
from aftershock.specs import CohortSpec, PhaseSpec


def save_tables(database: str | None = None) -> Callable[[str, DataFrame], DataFrame]:
    """Store every mart as a managed table, in ``database`` if given."""
    prefix = f"{database}." if database else ""
    return lambda name, frame: save_mart(frame, prefix + name)


def build_marts(
    star: Star, spec: PhaseSpec, save: Callable[[str, DataFrame], DataFrame]
) -> dict[str, DataFrame]:
    """Build and store every mart; returns the stored frames by name.

    Bases and activity sets are stored first. The other monthly marts come from those tables
    and read no facts. Orders meet their deliveries and ratings once, in ``linked_days``.
    """
    marts: dict[str, DataFrame] = {}

    def keep(name: str, frame: DataFrame) -> DataFrame:
        marts[name] = save(name, frame)
        return marts[name]

    orders = dated(star.fact_orders, spec)
    deliveries, ratings = star.fact_delivery_performance, star.fact_ratings
    keep("clean_fact_ratings", clean_ratings(ratings))
    keep("dim_date", build_dim_date(star.fact_orders, spec))

    base = keep("monthly_base", monthly.monthly_base(orders))
    keep("monthly_order", monthly.monthly_order(base))
    keep("monthly_active_customer", monthly.monthly_active_customer(base))
    keep("cancellation_rate", monthly.cancellation_rate(base))
    keep("monthly_ordered_active_customer", monthly.monthly_ordered_active_customer(base))
    keep("revenue_per_active_customer", monthly.revenue_per_active_customer(base))
    keep("returning_customer_rate", monthly.returning_customer_rate(base))

    linked = keep("linked_days", link_days(orders, deliveries, ratings))
    links = keep("monthly_links", monthly.link_base_of_days(linked))
    keep("delivery_performance_summary", monthly.delivery_mart(links))
    keep("rating_summary", monthly.rating_mart(links))

    customers = keep("monthly_customer_activity", monthly.monthly_customer_activity(orders))
    keep("returning_customer", monthly.returning_customer(customers))

    served = keep("monthly_rest_activity", monthly.monthly_rest_activity(orders))
    keep("monthly_active_res", monthly.monthly_active_res(served))
    keep("restaurant_activity_summary", monthly.restaurant_activity_summary(served, star.dim_restaurant))
    keep("churn_restaurants", monthly.churn_restaurants(served))
    keep("restaurant_churn_rate", monthly.restaurant_churn_rate(served))

    by_month = monthly.restaurants_by_month(served)
    master = keep("monthly_master_summary", monthly.master_from(base, links, by_month, spec))
    by_day = measures_of_days(linked, ["date"])
    days = keep("daily_summary", daily.daily_from(orders, by_day, spec))
    keep("phase_comparison", phases.phase_comparison(master))
    keep("orders_per_active_customer_day", daily.orders_per_active_customer_day(days))
    return marts


def build_checks(
    star: Star, marts: dict[str, DataFrame], save: Callable[[str, DataFrame], DataFrame]
) -> dict[str, DataFrame]:
    """Audit of the base tables and the stored marts: unknown keys, repeated keys, numbers of rows."""
    order, months = ["order_id"], list(monthly.KEYS)
    grains = {
        "fact_orders": (star.fact_orders, order),
        "fact_delivery_performance": (star.fact_delivery_performance, order),
        "fact_ratings": (star.fact_ratings, order),
        "dim_restaurant": (star.dim_restaurant, ["restaurant_id"]),
        "restaurant_churn_rate": (marts["restaurant_churn_rate"], months),
        "monthly_master_summary": (marts["monthly_master_summary"], months),
        "daily_summary": (marts["daily_summary"], ["date"]),
    }
    checks = {
        "null_key_audit": quality.null_key_audit(star),
        "grain_report": quality.grain_report(grains),
        "mart_row_counts": quality.row_counts(marts),
    }
    return {name: save(name, frame) for name, frame in checks.items()}


def build_reports(
    star: Star,
    spec: PhaseSpec,
    cohort: CohortSpec,
    linked: DataFrame,
    save: Callable[[str, DataFrame], DataFrame],
) -> dict[str, DataFrame]:
    """Store every diagnostic report; ``linked`` is the stored ``linked_days``."""
    reports: dict[str, DataFrame] = {}

    def keep(name: str, frame: DataFrame) -> DataFrame:
        reports[name] = save(name, frame)
        return reports[name]

    orders = dated(star.fact_orders, spec)
    deliveries, ratings, places = star.fact_delivery_performance, star.fact_ratings, star.dim_restaurant
    weeks = keep("weekly_kpis", weekly.weekly_of_days(orders, linked))
    keep("baseline_index", weekly.baseline_index(weeks))
    keep("phase_spans", weekly.phase_spans(weeks))
    keep("phase_revenue_decomposition", phases.phase_revenue_decomposition(orders))
    keep("phase_customer_overlap", phases.phase_customer_overlap(orders, spec))
    keep("new_vs_returning", phases.new_vs_returning(star.fact_orders, spec))
    keep("cohort_ops_retention", cohorts.cohort_ops_retention(orders, deliveries, cohort))
    keep("cohort_rating_retention", cohorts.cohort_rating_retention(orders, deliveries, ratings, cohort))
    flags = cohorts.cohort_rating_retention(orders, deliveries, ratings, cohort, group_by=cohorts.RATING_FLAGS)
    keep("cohort_flag_retention", flags)
    keep("frequency_bucket_retention", cohorts.frequency_bucket_retention(orders, cohort))
    keep("cohort_retention_curve", cohorts.cohort_retention_curve(orders, cohort))
    keep("restaurant_tier_by_phase", restaurants.restaurant_tier_by_phase(orders))
    keep("top_restaurants_pre", restaurants.top_restaurants_pre(orders, places, spec))
    keep("top_restaurants_across_phases", restaurants.top_restaurants_across_phases(orders, places))
    city = keep("city_revenue", cities.city_revenue(orders, places))
    keep("city_phase", cities.city_phase(orders, places))
    keep("city_revenue_wide", cities.city_revenue_wide(orders, places))
    keep("restaurant_coverage", cities.restaurant_coverage(city))
    keep("revenue_share_pivot", cities.revenue_share_pivot(city))
    return reports


def exports_of(reports: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The four frames to export, from stored reports, in report order."""
    flags = [F.desc("high_delay_flag"), F.desc("cancelled_flag")]
    return {
        "weekly_df": reports["weekly_kpis"].orderBy("week_start_date", "phase"),
        "retention_df": reports["cohort_ops_retention"].orderBy(*flags),
        "retention_rating_df": reports["cohort_rating_retention"].orderBy(F.desc("low_rating_flag")),
        "city_revenue_df": reports["city_revenue"].orderBy("city", phase_rank(F.col("phase"))),
    }


def report_frames(star: Star, spec: PhaseSpec, cohort: CohortSpec) -> dict[str, DataFrame]:
    """The four report frames, in report order, by the names of their exports."""
    orders = dated(star.fact_orders, spec)
    deliveries, ratings = star.fact_delivery_performance, star.fact_ratings
    return {
        "weekly_df": weekly.weekly_kpis(orders, deliveries, ratings).orderBy("week_start_date", "phase"),
        "retention_df": cohorts.cohort_ops_retention(orders, deliveries, cohort),
        "retention_rating_df": cohorts.cohort_rating_retention(orders, deliveries, ratings, cohort),
        "city_revenue_df": cities.city_revenue(orders, star.dim_restaurant).orderBy(
            "city", phase_rank(F.col("phase"))
        ),
    }
