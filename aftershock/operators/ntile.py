"""Exact ``ntile`` over a whole frame, without putting the frame into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aftershock.session import shared_dir

# Last decile of each tier, and its label.
TIERS = ((1, "Top_10%"), (3, "Next_20%"), (10, "Bottom_70%"))

# monotonically_increasing_id: partition number above this bit, row number below it.
ROW_BITS = 33


def global_ntile(frame: DataFrame, order: list[Column], tiles: int, name: str = "tile") -> DataFrame:
    """Number the rows 1..``tiles`` in ``order``, as ``ntile(tiles) over (order by …)`` does.

    ``order`` must be total, ending in a unique column. Range sorting spreads the rows
    evenly, as unique sort keys leave no value that owns a whole partition. The sorted rows
    are checkpointed once, because the positions and the partition sizes have to come from
    the same sort. Only the partition sizes meet in one task.
    """
    shared_dir(frame.sparkSession)
    position = F.monotonically_increasing_id()
    placed = (
        frame.orderBy(*order)
        .withColumn("pos", position)
        .withColumn("part", F.shiftright("pos", ROW_BITS))
        .withColumn("in_part", F.col("pos").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + 1)
        .drop("pos")
        .checkpoint()
    )
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    parts = Window.orderBy("part")
    earlier = parts.rowsBetween(Window.unboundedPreceding, -1)
    everything = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row per partition of the sort.
    offsets = sizes.select(
        "part",
        F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"),
        F.sum("size").over(everything).alias("total"),
    )
    rank = F.col("offset") + F.col("in_part")
    ranked = placed.join(F.broadcast(offsets), "part").withColumn("rank", rank)
    return ranked.withColumn(name, tile_of(F.col("rank"), F.col("total"), tiles)).drop(
        "part", "in_part", "offset", "total", "rank"
    )


def tile_of(rank: Column, total: Column, tiles: int) -> Column:
    """Tile of a 1-based rank: the first ``total % tiles`` tiles hold one row more."""
    small = F.floor(total / F.lit(tiles))
    larger_tiles = total % F.lit(tiles)
    in_larger = larger_tiles * (small + 1)
    return (
        F.when(rank <= in_larger, F.ceil(rank / (small + 1)))
        .otherwise(larger_tiles + F.ceil((rank - in_larger) / F.nullif(small, F.lit(0))))
        .cast("int")
    )


def tier_by_ntile(
    frame: DataFrame,
    order: list[Column],
    tiers: tuple[tuple[int, str], ...] = TIERS,
    name: str = "restaurant_tier",
) -> DataFrame:
    """Label rows by tile: ``tiers`` lists each label with its last tile, in ascending order."""
    ranked = global_ntile(frame, order, tiers[-1][0])
    label = F.coalesce(*[F.when(F.col("tile") <= last, text) for last, text in tiers])
    return ranked.withColumn(name, label).drop("tile")


def tier_rank(tier: Column, tiers: tuple[tuple[int, str], ...] = TIERS) -> Column:
    """Sort key of a label: the order of the tiers."""
    return F.coalesce(*[F.when(tier == text, place) for place, (_, text) in enumerate(tiers, start=1)])
