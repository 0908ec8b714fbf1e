"""Measure expressions shared by the marts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(38,4)"


def is_kept() -> Column:
    return F.col("is_cancelled") == "N"


def is_cancelled() -> Column:
    return F.col("is_cancelled") == "Y"


def count_when(condition: Column) -> Column:
    """Rows for which the condition holds; unknown counts as no."""
    return F.count(F.when(condition, 1))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Double ratio, NULL on a zero denominator."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def decimal_ratio(numerator: Column, denominator: Column, result: str) -> Column:
    """Exact decimal ratio rounded half up into ``result``; NULL on a zero denominator.

    The operand types leave the quotient 18 decimals, so the final cast rounds a value
    that has not been rounded at a nearby digit before.
    """
    exact = numerator.cast("decimal(24,4)") / F.nullif(denominator.cast("decimal(13,0)"), F.lit(0).cast("decimal(13,0)"))
    return exact.cast(result)


def weighted_mean(value: Column, weight: Column) -> Column:
    return safe_ratio(F.sum(value * weight), F.sum(weight))


def rate(condition: Column) -> Column:
    """Share of rows for which the condition holds; unknown counts as no."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))
