"""Exact distinct counts that can be merged: bitmaps of numbered ids by period.

Every id gets a number once. A day then has a bitmap per 32,768 numbers, and the distinct ids of a week, a
month or a phase are the bits of its days put together by ``or``: any grain comes from one
stored table, without a shuffle of ids. A bitmap takes 4 KB before compression, so the store pays where
a day sees more than a few hundredths of the ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aftershock.session import shared_dir

# monotonically_increasing_id: partition number above this bit, row number below it.
ROW_BITS = 33
BUCKET = "bucket"


def numbered(frame: DataFrame, key: str) -> DataFrame:
    """Rows (``key``, number): 1, 2, 3 … for the distinct known ids, in no particular order.

    Rows are numbered within partitions, and only the partitions' sizes meet in one task. The ids are
    checkpointed, as numbers and sizes have to come from the same partitions.
    """
    shared_dir(frame.sparkSession)
    ids = frame.select(key).filter(F.col(key).isNotNull()).distinct()
    placed = ids.withColumn("pos", F.monotonically_increasing_id())
    placed = placed.withColumn("part", F.shiftright("pos", ROW_BITS)).checkpoint()
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(Window.orderBy("part")) - F.col("size")
    # A row per partition.
    offsets = F.broadcast(sizes.select("part", before.alias("before")))
    row = F.col("pos") - F.shiftleft("part", ROW_BITS)
    return placed.join(offsets, "part").select(key, (F.col("before") + row + 1).alias("number"))


def extend_numbers(numbers: DataFrame, frame: DataFrame, key: str) -> DataFrame:
    """Numbers of further ids after the known ones, which keep theirs."""
    fresh = numbered(frame.join(numbers, key, "left_anti"), key)
    most = numbers.agg(F.max("number")).first()[0] or 0
    return numbers.unionByName(fresh.withColumn("number", F.col("number") + most))


def period_bitmaps(rows: DataFrame, periods: list[str], entity: str, numbers: DataFrame, **marked: Column) -> DataFrame:
    """Rows (``periods``, bucket, a bitmap per name) of the ids that have a row meeting the condition.

    An id on many rows of a period collapses on the map side, before it meets its number. Unknown ids
    have no bit.
    """
    known = rows.filter(F.col(entity).isNotNull()).select(*periods, entity, *[c.alias(n) for n, c in marked.items()])
    flags = known.groupBy(*periods, entity).agg(*[F.max(F.coalesce(n, F.lit(False))).alias(n) for n in marked])
    at, bucket = F.bitmap_bit_position("number"), F.bitmap_bucket_number("number")
    placed = flags.join(numbers, entity).withColumn(BUCKET, bucket)
    maps = [F.bitmap_construct_agg(F.when(F.col(n), at)).alias(n) for n in marked]
    return placed.groupBy(*periods, BUCKET).agg(*maps)


def merged(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    """Bitmaps of coarser periods; the same as those of their rows."""
    names = [c for c, kind in bitmaps.dtypes if kind == "binary"]
    return bitmaps.groupBy(*keys, BUCKET).agg(*[F.bitmap_or_agg(n).alias(n) for n in names])


def distinct_counts(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers of distinct ids by ``keys``, under the names of the bitmaps."""
    names = [c for c, kind in bitmaps.dtypes if kind == "binary"]
    counted = merged(bitmaps, keys).select(*keys, *[F.bitmap_count(n).alias(n) for n in names])
    return counted.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])
