"""Stored marts brought up to date by the months that new files touch.

:func:`update_marts` compares the files of the base tables with those the last build has seen, finds
the days that new rows fall on (late rows included), and writes only the periods whose
results can differ. All marts become visible together; see ``sinks.versions``.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aftershock.functions.calendar import dated, within
from aftershock.operators.calendar import build_dim_date
from aftershock.operators.linked import link_days, measures_of_days
from aftershock.operators.quality import clean_ratings
from aftershock.plans import daily, monthly, phases, weekly
from aftershock.sinks.versions import Build, MartStore
from aftershock.sources.changes import Changes, listing, touched_days
from aftershock.sources.star import SCHEMAS, Star, normalize_orders, read_star
from aftershock.specs import PhaseSpec, Span, month_shifted

Months = set[date] | None
FACTS = ("fact_orders", "fact_delivery_performance", "fact_ratings")


@dataclass(frozen=True)
class Update:
    """What an update did: ``days`` touched (None: everything was built), and whether it published."""

    days: list[date] | None
    published: bool


def update_marts(store: MartStore, root: str, spec: PhaseSpec, normalized: bool = True) -> Update:
    """Bring the marts of ``store`` up to date with the base tables under ``root``.

    Rows are only ever added as new files to tables such as ``sinks.write.save_star`` stores.
    Where files of orders, deliveries or ratings have changed or gone, or the phase cuts are
    others, everything is built anew. Without any change nothing is written. An update that fails
    leaves the marts as they were.
    """
    spark = store.spark
    build = store.begin()
    now = listing(spark, root)
    cuts = [spec.crisis_start.isoformat(), spec.post_start.isoformat()]
    changes = Changes.between(build.notes.get("files", {}), now)
    star = read_star(spark, root, normalized=normalized)
    anew = build.base is None or build.notes.get("cuts") != cuts or bool(changes.rewritten & {*FACTS})
    days: list[date] | None = None
    if not anew:
        if not changes.added and not changes.rewritten:
            return Update([], False)
        added = Star(lambda name: _read_files(star, name, changes.added[name], normalized))
        days = touched_days(star, added, {*changes.added})
    new_ratings = star.fact_ratings if anew else None
    if not anew and "fact_ratings" in changes.added:
        new_ratings = added.fact_ratings
    refresh_marts(star, spec, build, days, new_ratings, anew or changes.touch("dim_restaurant"))
    build.notes = {"files": now, "cuts": cuts}
    build.publish()
    return Update(days, True)


def _read_files(star: Star, name: str, paths: list[str], normalized: bool) -> DataFrame:
    frame = getattr(star, name).sparkSession.read.schema(SCHEMAS[name]).parquet(*paths)
    return normalize_orders(frame) if name == "fact_orders" and not normalized else frame


def refresh_marts(
    star: Star,
    spec: PhaseSpec,
    build: Build,
    days: Collection[date] | None,
    new_ratings: DataFrame | None,
    new_places: bool,
) -> None:
    """Write all periods of all marts whose results depend on orders of ``days`` (None: all days).

    The month of a touched day is computed anew from its orders, which a scan of the stored
    orders finds by time; returning customers and churn also depend on the month before, so
    their marts are written for the following month too. Marts made of other marts read the
    stored periods they need.
    """
    touched = None if days is None else {d.replace(day=1) for d in days}
    after = _with_next(touched)
    around = _with_previous(after)
    month, month_of_day = _text(F.col("month_start_date")), _text(F.trunc("date", "month"))
    monday_month = _text(F.trunc("week_start_date", "month"))

    def stored(name: str, months: Months) -> DataFrame:
        return build.read(name, _texts(months))

    if new_ratings is not None:
        label = "all" if days is None else build.id
        build.refresh("clean_fact_ratings", clean_ratings(new_ratings), F.lit(label), None if days is None else {label})
    if days is None or days:
        orders = dated(in_months(star.fact_orders, touched), spec)
        neighbours = dated(in_months(star.fact_orders, around), spec)
        deliveries, ratings = star.fact_delivery_performance, star.fact_ratings
        if days is not None:
            # Satellites of other months go before they are shuffled, if the ids are few enough to broadcast.
            ids = orders.filter("order_id IS NOT NULL").select("order_id").distinct()
            deliveries, ratings = (s.join(ids, "order_id", "left_semi") for s in (deliveries, ratings))
        build.refresh_all(
            {
                "dim_date": (build_dim_date(orders, spec), month, _texts(touched)),
                "monthly_base": (monthly.monthly_base(neighbours), month, _texts(after)),
                "linked_days": (link_days(orders, deliveries, ratings), month_of_day, _texts(touched)),
                "monthly_customer_activity": (monthly.monthly_customer_activity(orders), month, _texts(touched)),
                "monthly_rest_activity": (monthly.monthly_rest_activity(orders), month, _texts(touched)),
            }
        )

        base, linked = stored("monthly_base", after), stored("linked_days", touched)
        customers, served = stored("monthly_customer_activity", around), stored("monthly_rest_activity", around)
        churn = monthly.restaurant_churn_rate(served)
        by_day = measures_of_days(linked, ["date"])
        mondays = None if days is None else {_monday(d).replace(day=1) for d in days}
        near_mondays = _with_previous(_with_next(mondays))
        weeks = weekly.weekly_of_days(dated(in_months(star.fact_orders, near_mondays), spec), stored("linked_days", near_mondays))
        build.refresh_all(
            {
                "monthly_links": (monthly.link_base_of_days(linked), month, _texts(touched)),
                "monthly_active_res": (monthly.monthly_active_res(stored("monthly_rest_activity", touched)), month, _texts(touched)),
                "daily_summary": (daily.daily_from(orders, by_day, spec), month_of_day, _texts(touched)),
                "weekly_kpis": (weeks, monday_month, _texts(mondays)),
                "returning_customer": (monthly.returning_customer(customers), month, _texts(after)),
                "restaurant_churn_rate": (churn, month, _texts(after)),
                "churn_restaurants": (monthly.churn_restaurants(served), month, _texts(after)),
                **{name: (plan(base), month, _texts(after)) for name, plan in OF_BASE.items()},
            }
        )

        links = stored("monthly_links", after)
        by_month = monthly.restaurants_by_month(served)
        build.refresh_all(
            {
                "delivery_performance_summary": (monthly.delivery_mart(stored("monthly_links", touched)), month, _texts(touched)),
                "rating_summary": (monthly.rating_mart(stored("monthly_links", touched)), month, _texts(touched)),
                "monthly_master_summary": (monthly.master_from(base, links, by_month, spec), month, _texts(after)),
            }
        )
        # A row per phase, from all months.
        build.replace("phase_comparison", phases.phase_comparison(build.read("monthly_master_summary")))
        frequency = daily.orders_per_active_customer_day(build.read("daily_summary"))
        build.replace("orders_per_active_customer_day", frequency)
    if days is None or days or new_places:
        months = None if new_places else touched
        summary = monthly.restaurant_activity_summary(stored("monthly_rest_activity", months), star.dim_restaurant)
        build.refresh("restaurant_activity_summary", summary, month, _texts(months))


# Marts that are projections of the stored monthly base.
OF_BASE = {
    "monthly_order": monthly.monthly_order,
    "monthly_active_customer": monthly.monthly_active_customer,
    "cancellation_rate": monthly.cancellation_rate,
    "monthly_ordered_active_customer": monthly.monthly_ordered_active_customer,
    "revenue_per_active_customer": monthly.revenue_per_active_customer,
    "returning_customer_rate": monthly.returning_customer_rate,
}


def in_months(orders: DataFrame, months: Months) -> DataFrame:
    """Orders placed in the given months, by ranges of time that reach the scan."""
    if months is None:
        return orders
    condition = F.lit(False)
    for span in spans_of(months):
        condition = condition | within(F.col("order_timestamp"), span)
    return orders.filter(condition)


def spans_of(months: Collection[date]) -> list[Span]:
    """Neighbouring months as one span."""
    spans: list[Span] = []
    for start in sorted(months):
        end = month_shifted(start, 1)
        if spans and spans[-1].end == start:
            spans[-1] = Span(spans[-1].start, end)
        else:
            spans.append(Span(start, end))
    return spans


def _with_next(months: Months) -> Months:
    return None if months is None else months | {month_shifted(m, 1) for m in months}


def _with_previous(months: Months) -> Months:
    return None if months is None else months | {month_shifted(m, -1) for m in months}


def _texts(months: Months) -> set[str] | None:
    return None if months is None else {m.isoformat() for m in months}


def _text(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def _monday(day: date) -> date:
    """The label of a day's week, as ``functions.calendar.week_start`` gives it."""
    return day - timedelta(days=(day.weekday() + 1) % 7) + timedelta(days=1)
