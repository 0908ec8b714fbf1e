"""Monthly activity, returning customers, churn and the cohort curve, all from activity masks.

Each plan reads a mask table of ``operators.masks``, stored or lazy, and gives the rows of the plan
of the same name in ``plans.monthly`` or ``plans.cohorts``. Beyond the table, only counts per month and
phase are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aftershock.functions.calendar import MONTH, month_number
from aftershock.functions.measures import count_when, safe_ratio
from aftershock.operators.masks import SPAN, kept_bits, months_of, returning_bits, seen_bits, staying_bits
from aftershock.plans import monthly
from aftershock.specs import CohortSpec, PHASES

KEYS = list(MONTH)


def customer_base(masks: DataFrame) -> DataFrame:
    """Active customers, buyers, and buyers who also bought in the month before."""
    known = masks.filter(F.col("customer_id").isNotNull())
    months = months_of(known, customers=seen_bits(), kept_customers=kept_bits(), returning_customers=returning_bits())
    # The unknown customer is nobody, but a month of only such orders has a row.
    others = months_of(masks.filter(F.col("customer_id").isNull()), customers=seen_bits()).select(*KEYS)
    rows = months.unionByName(others, allowMissingColumns=True)
    return rows.groupBy(*KEYS).agg(
        *[count_when(F.col(c)).alias(c) for c in ("customers", "kept_customers", "returning_customers")]
    )


def monthly_active_customer(masks: DataFrame) -> DataFrame:
    return monthly.monthly_active_customer(customer_base(masks))


def monthly_customer_activity(masks: DataFrame) -> DataFrame:
    return months_of(masks, "customer_id", bought=kept_bits()).drop("bought")


def returning_customer(masks: DataFrame) -> DataFrame:
    known = masks.filter(F.col("customer_id").isNotNull())
    back = months_of(known, back=returning_bits())
    return back.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("returning_customers"))


def returning_customer_rate(masks: DataFrame) -> DataFrame:
    return monthly.returning_customer_rate(customer_base(masks))


def monthly_rest_activity(masks: DataFrame) -> DataFrame:
    rows = months_of(masks, "restaurant_id", served=kept_bits()).drop("served")
    return rows.withColumnRenamed("restaurant_id", "non_cancel_rest_id")


def restaurant_base(masks: DataFrame, same_phase: bool = True) -> DataFrame:
    """Active, churned and gone restaurants by month; the unknown one is gone but not counted."""
    months = months_of(masks, "restaurant_id", active=kept_bits(), stays=staying_bits(same_phase))
    restaurant = F.col("restaurant_id")
    churned = ~F.col("stays") | restaurant.isNull()
    return months.groupBy(*KEYS).agg(
        F.count(restaurant).alias("active_restaurants"),
        F.count(F.when(churned, restaurant)).alias("churned_restaurants"),
        count_when(churned).alias("gone"),
    )


def monthly_active_res(masks: DataFrame) -> DataFrame:
    return restaurant_base(masks).select(*KEYS, "active_restaurants")


def restaurant_churn_rate(masks: DataFrame, same_phase: bool = True) -> DataFrame:
    return monthly.churn_rate_of(restaurant_base(masks, same_phase))


def churn_restaurants(masks: DataFrame, same_phase: bool = True) -> DataFrame:
    return restaurant_churn_rate(masks, same_phase).select(*KEYS, "churned_restaurants")


def cohort_retention_curve(masks: DataFrame, spec: CohortSpec) -> DataFrame:
    """Share of the cohort ordering in each month after the cohort window; any order counts.

    The window has to begin and end with a month. An entity has a row per four years, so telling who
    belongs to the cohort is a window over very few rows.
    """
    if spec.cohort.start.day != 1 or spec.cohort.end.day != 1:
        raise ValueError("masks know months: the cohort window must begin and end at the start of one")
    first, end = (d.year * 12 + d.month for d in (spec.cohort.start, spec.cohort.end))
    seen = F.lit(0).cast("bigint")
    for phase in PHASES:
        seen = seen.bitwiseOR(F.col(f"seen_{phase}"))
    base = F.col("span") * SPAN - 1  # the month number of bit 0
    in_window = seen.bitwiseAND(_bits_between(first - base, end - base)) != 0
    mine = Window.partitionBy("customer_id")
    marked = masks.withColumn("member", F.max(in_window).over(mine)).withColumn("seen", seen)
    # One entity has several rows: only one of them counts it.
    ahead = F.row_number().over(mine.orderBy("span")) == 1
    marked = marked.withColumn("counted", F.col("member") & ahead)
    size = marked.agg(count_when(F.col("counted")).alias("cohort_size"))
    months = months_of(marked, "customer_id", "member", seen=seen_bits())
    number = month_number(F.col(MONTH[0]))
    # A cut within a month gives an entity two rows for it.
    later = months.filter(number >= end).select(MONTH[0], "customer_id", "member").distinct()
    counted = later.groupBy(MONTH[0]).agg(F.count(F.when(F.col("member"), F.col("customer_id"))).alias("active_customers"))
    # A row per month and one for the size.
    both = counted.unionByName(size, allowMissingColumns=True)
    sized = both.withColumn("cohort_size", F.max("cohort_size").over(Window.partitionBy()))
    return sized.filter(F.col(MONTH[0]).isNotNull()).select(
        MONTH[0],
        (month_number(F.col(MONTH[0])) - end + 1).cast("int").alias("months_after_cohort"),
        "active_customers",
        "cohort_size",
        safe_ratio(F.col("active_customers"), F.col("cohort_size")).alias("retention_rate"),
    )


def _bits_between(low, high):
    """The bits ``low`` to ``high - 1`` of a row's own months, from places that may lie outside them."""
    low = F.least(F.greatest(low, F.lit(1)), F.lit(SPAN + 1)).cast("int")
    high = F.least(F.greatest(high, F.lit(1)), F.lit(SPAN + 1)).cast("int")
    one = F.lit(1).cast("bigint")
    return F.call_function("shiftleft", one, high) - F.call_function("shiftleft", one, low)
