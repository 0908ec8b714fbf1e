"""Cohort retention: who of a cohort comes back, split by what they went through.

One aggregate per customer replaces the joins of cohort, experience and outcome: every
order contributes to the windows it falls in, and evidence from deliveries or ratings is
appended as rows that carry a flag. One shuffle on the customer, combined on the map side.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aftershock.functions.calendar import within
from aftershock.functions.measures import count_when, is_cancelled, is_kept, rate, safe_ratio
from aftershock.operators.dimension import salt_of, with_salts
from aftershock.operators.linked import actual_minutes, expected_minutes
from aftershock.specs import CohortSpec, Span

# Tasks over which the customers of one order id are spread.
SALTS = 8


def during(span: Span) -> Column:
    return within(F.col("order_timestamp"), span)


def cohort_customers(
    orders: DataFrame,
    spec: CohortSpec,
    kept_only: bool,
    flags: dict[str, Column] | None = None,
    evidence: list[DataFrame] | None = None,
) -> DataFrame:
    """One row per cohort customer: ``cohort_orders``, ``retained`` and the flags as 0/1.

    ``kept_only`` restricts cohort and outcome to orders that were not cancelled. ``flags``
    are conditions on orders of the experience window, ``evidence`` frames of
    ``customer_id`` and further flags. The unknown customer can be a member, but neither
    their experience nor their outcome can be told, so both stay 0.
    """
    flags, evidence = flags or {}, evidence or []
    counts = is_kept() if kept_only else F.lit(True)
    member = during(spec.cohort) & counts
    known = F.col("customer_id").isNotNull()
    exposed = during(spec.experience)
    spans = [spec.cohort, spec.outcome] + ([spec.experience] if flags else [])
    relevant = reduce(or_, [during(span) for span in spans])
    rows = orders.filter(relevant).select(
        "customer_id",
        F.when(member, 1).otherwise(0).alias("cohort_orders"),
        F.when(known & during(spec.outcome) & counts, 1).otherwise(0).alias("retained"),
        *[F.when(known & exposed & hit, 1).otherwise(0).alias(name) for name, hit in flags.items()],
    )
    names = list(flags)
    for frame in evidence:
        names += [c for c in frame.columns if c != "customer_id"]
        rows = rows.unionByName(frame.filter(known), allowMissingColumns=True)
    per_customer = rows.groupBy("customer_id").agg(
        F.sum("cohort_orders").alias("cohort_orders"),
        _any("retained"),
        *[_any(name) for name in names],
    )
    return per_customer.filter(F.col("cohort_orders") > 0)


def _any(flag: str) -> Column:
    return F.coalesce(F.max(flag), F.lit(0)).alias(flag)


def delivery_evidence(
    orders: DataFrame, deliveries: DataFrame, spec: CohortSpec, flags: dict[str, Column]
) -> DataFrame:
    """Customers whose orders of the experience window had a delivery matching a flag.

    Only deliveries that match some flag leave the scan, one row per order.
    """
    return _evidence(orders.filter(during(spec.experience)), deliveries, flags)


def rating_evidence(
    orders: DataFrame, ratings: DataFrame, spec: CohortSpec, flags: dict[str, Column]
) -> DataFrame:
    """Customers whose kept orders of the experience window had a rating matching a flag."""
    return _evidence(orders.filter(during(spec.experience) & is_kept()), ratings, flags)


def _evidence(orders: DataFrame, satellite: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Matches of the window's order ids only, joined to distinct orders and customers.

    An id on many orders of one customer collapses; of many customers it is spread by salts,
    as the matches of one window are few enough to be copied.
    """
    some = reduce(or_, flags.values())
    pairs = orders.filter(F.col("order_id").isNotNull()).select("order_id", "customer_id").distinct()
    matches = (
        satellite.filter(some)
        .groupBy("order_id")
        .agg(*[F.max(F.when(hit, 1).otherwise(0)).alias(name) for name, hit in flags.items()])
        .join(pairs.select("order_id").distinct(), "order_id", "left_semi")
    )
    salted = pairs.withColumn("salt", salt_of(F.col("customer_id"), SALTS))
    return salted.join(with_salts(matches, SALTS), ["order_id", "salt"]).drop("order_id", "salt")


def cohort_ops_retention(orders: DataFrame, deliveries: DataFrame, spec: CohortSpec) -> DataFrame:
    """Retention by late delivery and cancellation; cancelled orders make members and returns too."""
    late = {"high_delay_flag": actual_minutes() - expected_minutes() > 15}
    customers = cohort_customers(
        orders,
        spec,
        kept_only=False,
        flags={"cancelled_flag": is_cancelled()},
        evidence=[delivery_evidence(orders, deliveries, spec, late)],
    )
    by_flags = customers.groupBy("high_delay_flag", "cancelled_flag").agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.sum("retained").alias("retained_customers"),
        rate(F.col("retained") == 1).alias("retention_rate"),
    )
    return by_flags.select(F.lit(spec.name).alias("cohort_name"), "*").orderBy(
        F.desc("high_delay_flag"), F.desc("cancelled_flag")
    )


RATING_FLAGS = (
    "june_non_cancel_order_flag",
    "june_cancelled_flag",
    "delay_diff_flag",
    "long_delivery_flag",
    "low_rating_flag",
)


def cohort_rating_retention(
    orders: DataFrame,
    deliveries: DataFrame,
    ratings: DataFrame,
    spec: CohortSpec,
    group_by: tuple[str, ...] = ("low_rating_flag",),
) -> DataFrame:
    """Retention of kept-order customers by any of ``RATING_FLAGS``.

    Deliveries and ratings are read only where a chosen flag needs them.
    """
    unknown = set(group_by) - set(RATING_FLAGS)
    if unknown:
        raise ValueError(f"unknown flags: {sorted(unknown)}")
    order_flags = {"june_non_cancel_order_flag": is_kept(), "june_cancelled_flag": is_cancelled()}
    delivery_flags = {
        "delay_diff_flag": actual_minutes() - expected_minutes() > 10,
        "long_delivery_flag": actual_minutes() > 45,
    }
    rating_flags = {"low_rating_flag": F.col("rating") <= 2}

    def chosen(flags: dict[str, Column]) -> dict[str, Column]:
        return {name: hit for name, hit in flags.items() if name in group_by}

    evidence = []
    if chosen(delivery_flags):
        evidence.append(delivery_evidence(orders, deliveries, spec, chosen(delivery_flags)))
    if chosen(rating_flags):
        evidence.append(rating_evidence(orders, ratings, spec, chosen(rating_flags)))
    customers = cohort_customers(
        orders, spec, kept_only=True, flags=chosen(order_flags), evidence=evidence
    )
    return (
        customers.groupBy(*group_by)
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.sum("retained").alias("retained_count"),
            rate(F.col("retained") == 1).alias("retention_rate"),
            F.avg("cohort_orders").alias("avg_may_order_count"),
        )
        .orderBy(*[F.desc(flag) for flag in group_by])
    )


def frequency_bucket_retention(orders: DataFrame, spec: CohortSpec) -> DataFrame:
    """Retention by how often a customer ordered within the cohort window."""
    n = F.col("cohort_orders")
    bucket = F.when(n == 1, "1_order").when(n == 2, "2_order").otherwise("3+_order")
    customers = cohort_customers(orders, spec, kept_only=True)
    return (
        customers.groupBy(bucket.alias("frequency_bucket"))
        .agg(F.count(F.lit(1)).alias("customer"), rate(F.col("retained") == 1).alias("retention_rate"))
        .orderBy("frequency_bucket")
    )


def cohort_retention_curve(orders: DataFrame, spec: CohortSpec) -> DataFrame:
    """Share of the cohort ordering in each month after the cohort window; any order counts.

    A customer has one row per month, so finding the members is a window of at most as many
    rows as there are months. The unknown customer counts into the size only.
    """
    member = during(spec.cohort)
    months = (
        orders.filter(F.col("order_timestamp") >= F.lit(spec.cohort.start))
        .groupBy("customer_id", "month_start_date")
        .agg(F.max(member).alias("member"), F.max(~member).alias("later"))
    )
    mine = Window.partitionBy("customer_id")
    first = F.min(F.when(F.col("member"), F.col("month_start_date"))).over(mine)
    joined = F.col("first") == F.col("month_start_date")
    back = F.col("first").isNotNull() & F.col("later")
    by_month = (
        months.withColumn("first", first)
        .groupBy("month_start_date")
        .agg(
            count_when(joined).alias("joined"),
            F.count(F.when(back, F.col("customer_id"))).alias("active_customers"),
            F.max("later").alias("later"),
        )
    )
    # One row per month.
    size = F.sum("joined").over(Window.partitionBy())
    since = F.months_between("month_start_date", F.trunc(F.lit(spec.cohort.end), "month"))
    return (
        by_month.withColumn("cohort_size", size)
        .filter("later")
        .select(
            F.col("month_start_date"),
            (since + 1).cast("int").alias("months_after_cohort"),
            "active_customers",
            "cohort_size",
            safe_ratio(F.col("active_customers"), F.col("cohort_size")).alias("retention_rate"),
        )
    )
