"""The star schema and its file source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Only the columns any query touches; wider tables are read through these projections.
SCHEMAS: dict[str, T.StructType] = {
    "fact_orders": T.StructType(
        [
            T.StructField("order_id", T.LongType()),
            T.StructField("customer_id", T.LongType()),
            T.StructField("restaurant_id", T.LongType()),
            T.StructField("order_timestamp", T.TimestampType()),
            T.StructField("subtotal_amount", T.DecimalType(18, 4)),
            T.StructField("discount_amount", T.DecimalType(18, 4)),
            T.StructField("delivery_fee", T.DecimalType(18, 4)),
            T.StructField("total_amount", T.DecimalType(18, 4)),
            T.StructField("is_cancelled", T.StringType()),
        ]
    ),
    "fact_order_items": T.StructType(
        [
            T.StructField("order_id", T.LongType()),
            T.StructField("menu_item_id", T.LongType()),
            T.StructField("quantity", T.DoubleType()),
            T.StructField("line_amount", T.DoubleType()),
        ]
    ),
    "fact_delivery_performance": T.StructType(
        [
            T.StructField("order_id", T.LongType()),
            T.StructField("expected_delivery_time_mins", T.IntegerType()),
            T.StructField("actual_delivery_time_mins", T.IntegerType()),
        ]
    ),
    "fact_ratings": T.StructType(
        [
            T.StructField("order_id", T.LongType()),
            T.StructField("customer_id", T.LongType()),
            T.StructField("rating", T.DoubleType()),
            T.StructField("sentiment_score", T.DoubleType()),
            T.StructField("review_timestamp", T.TimestampType()),
        ]
    ),
    "dim_restaurant": T.StructType(
        [
            T.StructField("restaurant_id", T.LongType()),
            T.StructField("restaurant_name", T.StringType()),
            T.StructField("city", T.StringType()),
            T.StructField("partner_type", T.StringType()),
            T.StructField("is_active", T.IntegerType()),
            T.StructField("avg_prep_time_min", T.StringType()),
        ]
    ),
    "dim_customer": T.StructType(
        [T.StructField("customer_id", T.LongType()), T.StructField("customer_name", T.StringType())]
    ),
    "dim_menu_item": T.StructType(
        [T.StructField("menu_item_id", T.LongType()), T.StructField("item_name", T.StringType())]
    ),
}

AMOUNTS = ("subtotal_amount", "discount_amount", "delivery_fee", "total_amount")


class Star:
    """The base tables as lazy DataFrames: ``star.fact_orders`` and so on.

    ``open_table`` gives the frame of a table name. It is asked on first use, so a query
    opens the tables it reads and no others.
    """

    def __init__(self, open_table: Callable[[str], DataFrame]):
        self._open_table = open_table

    @classmethod
    def of(cls, **frames: DataFrame) -> Star:
        return cls(frames.__getitem__)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        frame = self._open_table(name)
        setattr(self, name, frame)
        return frame

    def register(self) -> None:
        """Expose the tables to ``spark.sql`` under their own names."""
        for name in SCHEMAS:
            getattr(self, name).createOrReplaceTempView(name)


def normalize_amounts(orders: DataFrame) -> DataFrame:
    """The four money columns as ``decimal(18,4)``."""
    return orders.withColumns({c: F.col(c).cast("decimal(18,4)") for c in AMOUNTS})


def normalize_flags(orders: DataFrame) -> DataFrame:
    """Upper-case flag without trailing blanks: the source compares it case-insensitively."""
    return orders.withColumn("is_cancelled", F.upper(F.rtrim("is_cancelled")))


def normalize_orders(orders: DataFrame) -> DataFrame:
    return normalize_flags(normalize_amounts(orders))


def read_star(
    spark: SparkSession, root: str, fmt: str = "parquet", normalized: bool = False, **options: str
) -> Star:
    """Read ``<root>/<table>`` for every table, with declared schemas (no inference pass).

    Tables that ``sinks.write.save_star`` has stored are ``normalized``: their flags are read
    as they are, so that a filter on them reaches the scan.
    """

    def open_table(name: str) -> DataFrame:
        frame = spark.read.format(fmt).options(**options).schema(SCHEMAS[name]).load(f"{root}/{name}")
        return normalize_orders(frame) if name == "fact_orders" and not normalized else frame

    return Star(open_table)
