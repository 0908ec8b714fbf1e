"""The star schema in a relational database."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aftershock.sources.star import SCHEMAS, Star, normalize_orders


@dataclass(frozen=True)
class KeyRange:
    """Bounds of the numeric column that splits a table into concurrent reads.

    The bounds only place the splits; rows outside them land in the first and last one.
    """

    column: str
    lower: int
    upper: int
    partitions: int


def table_options(table: str, split: KeyRange | None) -> dict[str, str]:
    options = {"dbtable": table, "fetchsize": "10000"}
    if split is not None:
        options |= {
            "partitionColumn": split.column,
            "lowerBound": str(split.lower),
            "upperBound": str(split.upper),
            "numPartitions": str(split.partitions),
        }
    return options


def read_table(
    spark: SparkSession, url: str, table: str, split: KeyRange | None = None, **options: str
) -> DataFrame:
    """One table; filters and column choice are pushed into the database by Spark."""
    reader = spark.read.format("jdbc").option("url", url).options(**table_options(table, split))
    return reader.options(**options).load()


def typed(frame: DataFrame, name: str) -> DataFrame:
    """The columns of a base table with the types the file source has."""
    return frame.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name]])


def read_star(
    spark: SparkSession, url: str, splits: dict[str, KeyRange] | None = None, **options: str
) -> Star:
    """All tables. Give every fact table a :class:`KeyRange`, or one task reads it whole."""
    splits = splits or {}

    def open_table(name: str) -> DataFrame:
        frame = typed(read_table(spark, url, name, splits.get(name), **options), name)
        return normalize_orders(frame) if name == "fact_orders" else frame

    return Star(open_table)
