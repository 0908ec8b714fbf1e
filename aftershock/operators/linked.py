"""Delivery and rating measures brought to the calendar of their orders.

Both satellites hold any number of rows per order. They are reduced to one row per order
before the join: a hot order collapses on the map side. So do the orders, to one row per id
and period with a count, as an id can stand on any number of orders (a placeholder, say); the
sums are multiplied by that count. Only sums and counts cross the shuffles; means are taken at
the very end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aftershock.functions.measures import count_when, is_kept, safe_ratio
from aftershock.operators.dimension import fits_broadcast

DELIVERY_SUMS = [
    "deliveries",
    "expected_sum",
    "expected_n",
    "actual_sum",
    "actual_n",
    "delay_sum",
    "delay_n",
    "late_n",
]
# Bytes on disk up to which the sums of satellites are broadcast: a row per order, some twenty times as large decoded.
SMALL_SATELLITE = 4 * 1024 * 1024
RATING_SUMS = [
    "rating_count",
    "rating_sum",
    "rating_n",
    "low_n",
    "five_n",
    "one_n",
    "sentiment_sum",
    "sentiment_n",
]


def expected_minutes() -> Column:
    return F.col("expected_delivery_time_mins").cast("double")


def actual_minutes() -> Column:
    return F.col("actual_delivery_time_mins").cast("double")


def delivery_sums(deliveries: DataFrame) -> DataFrame:
    """One row per order."""
    expected, actual = expected_minutes(), actual_minutes()
    delay = actual - expected
    return deliveries.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("deliveries"),
        F.sum(expected).alias("expected_sum"),
        F.count(expected).alias("expected_n"),
        F.sum(actual).alias("actual_sum"),
        F.count(actual).alias("actual_n"),
        F.sum(delay).alias("delay_sum"),
        F.count(delay).alias("delay_n"),
        count_when(actual > expected).alias("late_n"),
    )


def rating_sums(ratings: DataFrame) -> DataFrame:
    """One row per order. A row without a value is neither low nor top."""
    rating = F.col("rating")
    sentiment = F.col("sentiment_score").cast("double")
    return ratings.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("rating_count"),
        F.sum(rating.cast("double")).alias("rating_sum"),
        F.count(rating).alias("rating_n"),
        count_when(rating <= 2).alias("low_n"),
        count_when(rating == 5).alias("five_n"),
        count_when(rating == 1).alias("one_n"),
        F.sum(sentiment).alias("sentiment_sum"),
        F.count(sentiment).alias("sentiment_n"),
    )


def delivery_columns() -> list[Column]:
    """Delivery KPIs from ``DELIVERY_SUMS``."""
    return [
        F.col("deliveries"),
        _mean("expected").alias("avg_expected_time_min"),
        _mean("actual").alias("avg_actual_time_min"),
        F.round(_mean("delay"), 5).alias("diff_minutes_decimal"),
        safe_ratio(F.col("late_n"), F.col("deliveries")).alias("late_rate"),
    ]


def rating_columns() -> list[Column]:
    """Rating KPIs from ``RATING_SUMS``; shares are over all rating rows."""
    five = safe_ratio(F.col("five_n"), F.col("rating_count"))
    one = safe_ratio(F.col("one_n"), F.col("rating_count"))
    return [
        F.col("rating_count"),
        _mean("rating").alias("avg_rating"),
        F.col("rating_n").alias("total_rating"),
        safe_ratio(F.col("low_n"), F.col("rating_count")).alias("low_rating_rate"),
        five.alias("five_start_rating"),
        one.alias("one_start_rating"),
        (five - one).alias("net_rating"),
        _mean("sentiment").alias("avg_sentiment"),
    ]


def _mean(measure: str) -> Column:
    return safe_ratio(F.col(f"{measure}_sum"), F.col(f"{measure}_n"))


def delivery_measures(orders: DataFrame, deliveries: DataFrame, keys: list[str]) -> DataFrame:
    """Delivery KPIs of the given orders by ``keys``; only periods with deliveries."""
    joined = met(orders, keys, deliveries, delivery_sums(deliveries))
    return sum_up(joined, keys, DELIVERY_SUMS).select(*keys, *delivery_columns())


def rating_measures(orders: DataFrame, ratings: DataFrame, keys: list[str]) -> DataFrame:
    """Rating KPIs of the given orders by ``keys``; only periods with ratings."""
    joined = met(orders, keys, ratings, rating_sums(ratings))
    return sum_up(joined, keys, RATING_SUMS).select(*keys, *rating_columns())


def met(orders: DataFrame, keys: list[str], satellites: DataFrame, sums: DataFrame) -> DataFrame:
    """Orders, with how many ``orders`` a row stands for, and the sums of their satellites.

    Where the satellites are read from few bytes, their sums are broadcast and the orders stay where
    they are; else the orders collapse to a row per id and period before they move. A session that
    turns broadcasts off gets none, so facts that are bucketed alike join in their buckets.
    """
    allowed = not orders.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").startswith("-")
    if allowed and fits_broadcast(satellites, SMALL_SATELLITE):
        return orders.select("order_id", *keys, F.lit(1).alias("orders")).join(F.broadcast(sums), "order_id")
    return counted(orders, keys).join(sums, "order_id")


def counted(orders: DataFrame, columns: list[str]) -> DataFrame:
    """One row per order id and ``columns``, with the number of its ``orders``; none for unknown ids.

    An id on many orders collapses on the map side, so the join that follows meets it once
    per period.
    """
    known = orders.filter(F.col("order_id").isNotNull())
    return known.groupBy("order_id", *columns).agg(F.count(F.lit(1)).alias("orders"))


def sum_up(frame: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Sums over orders of ``measures``, from rows that stand for several ``orders``."""
    return frame.groupBy(*keys).agg(*[F.sum(F.col(c) * F.col("orders")).alias(c) for c in measures])


def linked_orders(
    orders: DataFrame, columns: list[str], deliveries: DataFrame, ratings: DataFrame
) -> DataFrame:
    """:func:`counted` orders with both kinds of sums of one order; NULL sums where it has none.

    Marts that need deliveries and ratings take both from here, so the orders move to their
    id once. Orders without an id match nothing and would all meet in one task.
    """
    return (
        counted(orders, columns)
        .join(delivery_sums(deliveries), "order_id", "left")
        .join(rating_sums(ratings), "order_id", "left")
    )


LINK_DAYS = ["date", "phase", "is_kept"]


def link_days(orders: DataFrame, deliveries: DataFrame, ratings: DataFrame) -> DataFrame:
    """Sums of deliveries and ratings by day, phase and whether the order was kept.

    The one join of dated orders to their satellites that monthly, weekly and daily marts need.
    """
    marked = orders.withColumn("is_kept", F.coalesce(is_kept(), F.lit(False)))
    return sum_up(linked_orders(marked, LINK_DAYS, deliveries, ratings), LINK_DAYS, DELIVERY_SUMS + RATING_SUMS)


def measures_of_days(days: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`linked_measures` of kept orders, from :func:`link_days`."""
    of_kept = days.withColumns({c: F.when(F.col("is_kept"), F.col(c)) for c in DELIVERY_SUMS})
    sums = of_kept.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in DELIVERY_SUMS + RATING_SUMS])
    return sums.select(*keys, *delivery_columns(), *rating_columns())


def linked_measures(
    orders: DataFrame,
    deliveries: DataFrame,
    ratings: DataFrame,
    keys: list[str],
    delivered: Column,
) -> DataFrame:
    """Delivery KPIs of the orders meeting ``delivered``, and rating KPIs of all, by ``keys``."""
    marked = orders.withColumn("delivered", delivered)
    linked = linked_orders(marked, [*keys, "delivered"], deliveries, ratings)
    of_delivered = linked.withColumns({c: F.when(F.col("delivered"), F.col(c)) for c in DELIVERY_SUMS})
    sums = sum_up(of_delivered, keys, DELIVERY_SUMS + RATING_SUMS)
    return sums.select(*keys, *delivery_columns(), *rating_columns())
