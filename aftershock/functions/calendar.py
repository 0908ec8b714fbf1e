"""Calendar expressions: days, weeks, months and phases.

The calendar is a function of the order date, so facts get their calendar columns by
expression. That replaces a join with a calendar table made of the same facts, and
with it a second scan of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aftershock.specs import PhaseSpec, Span

MONTH = ("month_start_date", "phase")


def week_start(day: Column) -> Column:
    """Monday label of a Sunday-to-Saturday week: a Sunday belongs to the next day's Monday."""
    return F.date_add(day, F.lit(2) - F.dayofweek(day))


def month_number(day: Column) -> Column:
    """Consecutive integers for consecutive months."""
    return F.year(day) * 12 + F.month(day)


def assign_phase(day: Column, phases: PhaseSpec) -> Column:
    return (
        F.when(day < F.lit(phases.crisis_start), "pre")
        .when(day < F.lit(phases.post_start), "crisis")
        .when(day.isNotNull(), "post")
    )


def phase_rank(phase: Column) -> Column:
    """Chronological sort key; anything that is no known phase comes last."""
    return F.when(phase == "pre", 1).when(phase == "crisis", 2).when(phase == "post", 3).otherwise(4)


def within(timestamp: Column, span: Span) -> Column:
    """``[start, end)`` on the raw timestamp, which Parquet can push down."""
    return (timestamp >= F.lit(span.start)) & (timestamp < F.lit(span.end))


def before(timestamp: Column, day) -> Column:
    return timestamp < F.lit(day)


def calendar_columns(day: Column, phases: PhaseSpec) -> dict[str, Column]:
    """Calendar attributes of a day, in calendar-table order, with English names and Sunday = 1."""
    weekday = F.dayofweek(day)
    return {
        "date_key": F.date_format(day, "yyyyMMdd").cast("int"),
        "year": F.year(day),
        "month": F.month(day),
        "month_name": F.date_format(day, "MMMM"),
        "month_start_date": F.trunc(day, "month"),
        "year_month": F.date_format(day, "yyyy-MM"),
        "day_of_week": weekday,
        "day_name": F.date_format(day, "EEEE"),
        "is_weekend": F.when(weekday.isin(1, 7), 1).otherwise(0),
        "phase": assign_phase(day, phases),
    }


def dated(orders: DataFrame, phases: PhaseSpec) -> DataFrame:
    """Orders that have a date, with ``date``, ``month_start_date`` and ``phase``."""
    day = F.to_date("order_timestamp")
    return orders.filter(F.col("order_timestamp").isNotNull()).withColumns(
        {
            "date": day,
            "month_start_date": F.trunc(day, "month"),
            "phase": assign_phase(day, phases),
        }
    )
