"""The star schema derived from TPC-H-shaped tables plus an event log.

Orders, lines, suppliers and events play the parts of orders, deliveries, restaurants and
ratings. ``FIXTURES.md`` §2 states the mapping; its modulo expressions define column
values, none of them removes rows.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aftershock.operators.dimension import join_dimension
from aftershock.sources.star import Star, normalize_orders
from aftershock.specs import CohortSpec, PhaseSpec, Span

PHASES = PhaseSpec(date(1998, 1, 1), date(1999, 1, 1))
COHORT = CohortSpec(
    "h2_1997",
    cohort=Span(date(1997, 7, 1), date(1998, 1, 1)),
    experience=Span(date(1998, 1, 1), date(1998, 7, 1)),
    outcome=Span(date(1998, 7, 1), date(1999, 1, 1)),
)

SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
    " o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_quantity double, l_extendedprice double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "customer": "c_custkey bigint, c_name string",
    "part": "p_partkey bigint, p_name string",
}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}.parquet")


def order_lines(lineitem: DataFrame) -> DataFrame:
    """One row per order: first supplier, first line number, largest quantity."""
    return lineitem.groupBy(F.col("l_orderkey").alias("order_id")).agg(
        F.min("l_suppkey").alias("restaurant_id"),
        F.min("l_linenumber").alias("first_line"),
        F.max("l_quantity").alias("max_quantity"),
    )


def fact_orders(orders: DataFrame, lines: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    head = orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("order_timestamp"),
        F.col("o_totalprice").alias("subtotal_amount"),
        zero.alias("discount_amount"),
        zero.alias("delivery_fee"),
        F.col("o_totalprice").alias("total_amount"),
        F.when(F.col("o_orderstatus") == "P", "Y").otherwise("N").alias("is_cancelled"),
    )
    # The right side is unique on the key, so Catalyst drops this join where the
    # restaurant is not asked for.
    joined = head.join(lines.select("order_id", "restaurant_id"), "order_id", "left")
    return normalize_orders(joined)


def fact_delivery_performance(lines: DataFrame) -> DataFrame:
    expected = F.lit(25) + F.lit(5) * F.col("first_line")
    actual = expected + F.col("max_quantity").cast("int") - F.lit(30)
    return lines.select(
        "order_id",
        expected.alias("expected_delivery_time_mins"),
        actual.alias("actual_delivery_time_mins"),
    )


def fact_ratings(events: DataFrame) -> DataFrame:
    stars = F.col("event_type")
    # Stars by event type.
    rating = (
        F.when(stars == "error", 1.0)
        .when(stars == "click", 2.0)
        .when(stars == "view", 3.0)
        .when(stars == "signup", 4.0)
        .when(stars == "purchase", 5.0)
    )
    filled = F.col("event_id") % 50 != 0
    return events.select(
        F.when(filled, F.col("event_id")).alias("order_id"),
        F.when(filled, F.col("user_id")).alias("customer_id"),
        F.when(filled, rating).alias("rating"),
        F.when(filled, (F.col("event_id") % 21) / F.lit(20.0)).alias("sentiment_score"),
        F.when(filled, F.col("ts")).alias("review_timestamp"),
    )


def dim_restaurant(supplier: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    bucket = F.col("s_suppkey") % 6
    # Preparation-time labels.
    prep = (
        F.when(bucket == 0, "0-15")
        .when(bucket == 1, "16-25")
        .when(bucket == 2, "26-40")
        .when(bucket == 3, ">40")
        .when(bucket == 4, "18")
        .otherwise("n/a")
    )
    regions = region.withColumnRenamed("r_regionkey", "n_regionkey")
    places = join_dimension(nation, regions, "n_regionkey").withColumnRenamed("n_nationkey", "s_nationkey")
    return join_dimension(supplier, places, "s_nationkey").select(
        F.col("s_suppkey").alias("restaurant_id"),
        F.col("s_name").alias("restaurant_name"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("partner_type"),
        F.when(F.col("s_suppkey") % 5 == 0, 0).otherwise(1).alias("is_active"),
        prep.alias("avg_prep_time_min"),
    )


def read_star(spark: SparkSession, root: str) -> Star:
    def table(name: str) -> DataFrame:
        return read_table(spark, root, name)

    builders = {
        "fact_orders": lambda: fact_orders(table("orders"), order_lines(table("lineitem"))),
        "fact_order_items": lambda: table("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("menu_item_id"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_extendedprice").alias("line_amount"),
        ),
        "fact_delivery_performance": lambda: fact_delivery_performance(order_lines(table("lineitem"))),
        "fact_ratings": lambda: fact_ratings(table("events")),
        "dim_restaurant": lambda: dim_restaurant(table("supplier"), table("nation"), table("region")),
        "dim_customer": lambda: table("customer").select(
            F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name")
        ),
        "dim_menu_item": lambda: table("part").select(
            F.col("p_partkey").alias("menu_item_id"), F.col("p_name").alias("item_name")
        ),
    }
    return Star(lambda name: builders[name]())
