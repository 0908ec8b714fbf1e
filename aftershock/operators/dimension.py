"""Joining facts to a dimension of unknown size."""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bytes on disk up to which a dimension is broadcast. Decoded rows take a few times that,
# which still fits every executor.
BROADCAST_BYTES = 32 * 1024 * 1024
SALTS = 16


def scanned_bytes(frame: DataFrame) -> int | None:
    """Size of the tables a frame reads, from the optimizer's file statistics.

    For a dimension assembled by key lookups this bounds the result, where Spark's own
    estimate multiplies the sizes of both join sides. None when the session does not
    expose the plan.
    """
    try:
        leaves = frame._jdf.queryExecution().optimizedPlan().collectLeaves()
        return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    except (AttributeError, Py4JError):
        return None


def fits_broadcast(dimension: DataFrame, limit: int | None = None) -> bool:
    """Whether the files a dimension is read from are at most ``limit`` bytes (``BROADCAST_BYTES``)."""
    size = scanned_bytes(dimension)
    return size is not None and size <= (BROADCAST_BYTES if limit is None else limit)


def salt_of(column: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")


def with_salts(frame: DataFrame, salts: int) -> DataFrame:
    """A copy of each row per salt."""
    return frame.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def join_dimension(
    facts: DataFrame,
    dimension: DataFrame,
    key: str,
    spread_by: Column | None = None,
    limit: int | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """Inner-join ``facts`` to ``dimension``.

    A dimension of up to ``limit`` bytes is broadcast. A larger one is joined by shuffle;
    pass ``spread_by`` where one key may own a large part of the facts. Its rows then go
    to ``salts`` tasks by the hash of that column, each of which holds the dimension row.
    Facts that repeat key and ``spread_by`` should be made distinct before.
    """
    if fits_broadcast(dimension, limit):
        return facts.join(F.broadcast(dimension), key)
    if spread_by is None:
        return facts.join(dimension, key)
    salted = facts.withColumn("salt", salt_of(spread_by, salts))
    return salted.join(with_salts(dimension, salts), [key, "salt"]).drop("salt")
