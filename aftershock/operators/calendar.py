"""The calendar table and orders joined to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aftershock.functions.calendar import MONTH, calendar_columns
from aftershock.operators.dimension import fits_broadcast
from aftershock.specs import PhaseSpec


def build_dim_date(orders: DataFrame, phases: PhaseSpec) -> DataFrame:
    """One row per day with orders. Attributes are derived after the distinct, on days only."""
    days = orders.select(F.to_date("order_timestamp").alias("date")).distinct()
    return days.filter(F.col("date").isNotNull()).withColumns(
        calendar_columns(F.col("date"), phases)
    )


def orders_with_date(orders: DataFrame, phases: PhaseSpec) -> DataFrame:
    """Every order that has a date, with all calendar attributes.

    Equal to joining the calendar on the order date, as the calendar holds exactly the
    orders' dates; here it costs neither a join nor a second scan.
    """
    with_day = orders.filter(F.col("order_timestamp").isNotNull()).withColumn(
        "date", F.to_date("order_timestamp")
    )
    return with_day.withColumns(calendar_columns(F.col("date"), phases))


def dated_by(orders: DataFrame, calendar: DataFrame, *attributes: str) -> DataFrame:
    """Orders on the days of a given calendar, with its month, phase and ``attributes``.

    For a stored calendar that somebody has edited: moved phases, holidays, days left out. It has a row
    per ``date``; days without a row drop their orders, as do orders without a date. Its first and
    last day become a range of the raw timestamp, so a calendar of one phase reads the files and
    row groups of that phase only. A calendar of few bytes is broadcast; the orders then stay where they are.
    """
    columns = ["date", *MONTH, *attributes]
    days = calendar.filter(F.col("date").isNotNull()).select(*columns)
    # Two days and two counts of a table with a row per day.
    bounds = days.agg(
        F.min("date").alias("start"),
        F.date_add(F.max("date"), 1).alias("end"),
        F.count(F.lit(1)).alias("days"),
        F.countDistinct("date").alias("distinct"),
    ).first()
    if bounds.days != bounds.distinct:
        raise ValueError(f"the calendar has {bounds.days} rows for {bounds.distinct} days")
    moment = F.col("order_timestamp")
    inside = (moment >= F.lit(bounds.start)) & (moment < F.lit(bounds.end)) if bounds.days else F.lit(False)
    with_day = orders.filter(inside).withColumn("date", F.to_date("order_timestamp"))
    with_day = with_day.drop(*MONTH, *attributes)
    return with_day.join(F.broadcast(days) if fits_broadcast(days) else days, "date")
