"""Who was active when: activity sets, returning and churned entities.

An activity set holds one row per month, phase and entity, so a window over one entity
sees at most as many rows as there are months, however many orders the entity has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aftershock.functions.calendar import MONTH, month_number
from aftershock.functions.measures import is_kept


def active_set(orders: DataFrame, entity: str) -> DataFrame:
    """Distinct (month, phase, entity) over the orders that were not cancelled."""
    return orders.filter(is_kept()).select(*MONTH, entity).distinct()


def in_adjacent_month(marked: Column, entity: list[str], months: int) -> Column:
    """Whether the entity has a marked row exactly ``months`` later (negative: earlier).

    A range frame on the month number reads the neighbour month in the same pass where a
    self-join on a shifted month would shuffle the activity twice.
    """
    neighbour = (
        Window.partitionBy(*entity)
        .orderBy(month_number(F.col("month_start_date")))
        .rangeBetween(months, months)
    )
    return F.count(F.when(marked, 1)).over(neighbour) > 0


def returning(activity: DataFrame, entity: str) -> DataFrame:
    """Activity rows whose entity was also active in the previous calendar month."""
    back = in_adjacent_month(F.lit(True), [entity], -1)
    known = activity.filter(F.col(entity).isNotNull())
    return known.withColumn("back", back).filter("back").drop("back")


def flag_churned(activity: DataFrame, entity: str, same_phase: bool = True) -> DataFrame:
    """Adds ``churned``: the entity is not active in the next month.

    With ``same_phase`` activity counts only under the same phase, so at a phase cut
    every entity counts as churned. An unknown entity never matches, hence is churned.
    """
    partition = [entity, "phase"] if same_phase else [entity]
    stays = in_adjacent_month(F.lit(True), partition, 1)
    return activity.withColumn("churned", F.col(entity).isNull() | ~stays)
