"""Audits, cleaning and small table utilities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aftershock.sources.star import Star

RATING_FIELDS = ["order_id", "rating", "review_timestamp", "customer_id"]


def clean_ratings(ratings: DataFrame) -> DataFrame:
    """Drop ratings that carry nothing at all; partly filled ones stay."""
    return ratings.dropna(how="all", subset=RATING_FIELDS)


def null_key_audit(star: Star) -> DataFrame:
    """Rows without an order key, per fact table and for the cleaned ratings.

    Filter-then-count reads one column and lets Parquet skip the row groups whose
    statistics show no NULL.
    """
    audited = {
        "fact_order_items": star.fact_order_items,
        "fact_delivery_performance": star.fact_delivery_performance,
        "fact_orders": star.fact_orders,
        "fact_ratings": star.fact_ratings,
        "clean_fact_ratings": clean_ratings(star.fact_ratings),
    }
    counts = [
        frame.filter(F.col("order_id").isNull()).agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("null_rows")
        )
        for name, frame in audited.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def ratings_by_sentiment(ratings: DataFrame, value: float) -> DataFrame:
    """Ratings whose sentiment equals ``value``, compared as doubles."""
    return ratings.filter(F.col("sentiment_score") == F.lit(float(value)))


def grain_check(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; empty when the grain holds."""
    counted = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"))
    return counted.filter(F.col("cnt") > 1)


def grain_report(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """For each table, how many values of its keys occur more than once, and the rows they own."""
    counts = [
        grain_check(frame, keys).agg(
            F.lit(name).alias("table_name"),
            F.lit(", ".join(keys)).alias("grain"),
            F.count(F.lit(1)).alias("repeated_keys"),
            F.coalesce(F.sum("cnt"), F.lit(0)).alias("their_rows"),
        )
        for name, (frame, keys) in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """The number of rows of each table."""
    counts = [row_count(frame, "row_count").select(F.lit(name).alias("table_name"), "row_count") for name, frame in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def preview(frame: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """First ``n`` rows; without an order any ``n`` rows."""
    return (frame.orderBy(*order) if order else frame).limit(n)


def row_count(frame: DataFrame, name: str) -> DataFrame:
    return frame.agg(F.count(F.lit(1)).alias(name))


def describe_columns(spark: SparkSession, frame: DataFrame) -> DataFrame:
    """Column names and types in order. Reads the schema only, no rows."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(frame.schema, start=1)]
    return spark.createDataFrame(rows, "ordinal_position int, column_name string, data_type string")
