"""Order measures at any calendar grain, and exact distinct customers.

Additive measures combine on the map side to a row per period, so they cross no shuffle at
order volume. Distinct customers do, in a pass of their own that carries one flag: first a
row per period and customer, then the rollup. Both levels combine on the map side, so neither
a busy customer nor a busy period lands in one task, and no rows are multiplied as several
``count(distinct)`` in one aggregate would do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aftershock.functions.measures import MONEY, count_when, is_cancelled, is_kept, safe_ratio


def by_period(orders: DataFrame, keys: list[str]) -> DataFrame:
    """Additive measures; ``revenue`` counts cancelled orders as zero, ``priced`` the kept ones with an amount."""
    amount = F.col("total_amount")
    zero = F.lit(0).cast("decimal(18,4)")
    return orders.groupBy(*keys).agg(
        F.count("order_id").alias("order_ids"),
        F.count(F.lit(1)).alias("orders"),
        count_when(is_kept()).alias("kept"),
        count_when(is_cancelled()).alias("cancelled"),
        F.sum(F.when(is_kept(), amount).otherwise(zero)).cast(MONEY).alias("revenue"),
        F.count(F.when(is_kept(), amount)).alias("priced"),
    )


def average_order_value() -> Column:
    """Mean amount of kept orders that have one; exact sum, one division."""
    return safe_ratio(F.col("revenue"), F.col("priced"))


def period_customers(orders: DataFrame, keys: list[str]) -> DataFrame:
    """One row per period and customer; ``bought``: some order of theirs was kept."""
    bought = F.max(F.coalesce(is_kept(), F.lit(False)))
    return orders.groupBy(*keys, "customer_id").agg(bought.alias("bought"))


def count_customers(per_customer: DataFrame, keys: list[str], *extra: Column) -> DataFrame:
    """``customers`` with any order and ``kept_customers``, from one row per period and customer."""
    return per_customer.groupBy(*keys).agg(
        F.count("customer_id").alias("customers"),
        F.count(F.when(F.col("bought"), F.col("customer_id"))).alias("kept_customers"),
        *extra,
    )


def customers_by_period(orders: DataFrame, keys: list[str]) -> DataFrame:
    return count_customers(period_customers(orders, keys), keys)


def with_customers(orders: DataFrame, keys: list[str]) -> DataFrame:
    """Additive measures and customers, one row per period.

    Both parts have one row per period, so adding them up brings them together; unlike a
    join this keeps a period without a key.
    """
    parts = by_period(orders, keys).unionByName(
        customers_by_period(orders, keys), allowMissingColumns=True
    )
    measures = [c for c in parts.columns if c not in keys]
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in measures])
