"""Stored base tables, materialised marts, bucketed tables and CSV exports.

Every write overwrites, so a pipeline can be run again from the start.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aftershock.sinks.files import FileSystem
from aftershock.sources.star import SCHEMAS, Star


def save_star(star: Star, root: str, files: int) -> None:
    """Store the base tables as Parquet under ``root``, for ``sources.star.read_star``.

    Orders are laid out by time in ``files`` ranges, so that scans for a phase or a cohort
    window skip most row groups. The ids in the range key split a moment that owns many
    orders. Skipping needs sessions like ``build_session`` makes: Spark 4.1 uses the
    statistics of ``TIMESTAMP_MICROS`` columns only, not of INT96 or zone-less ones.
    """
    for name in SCHEMAS:
        frame = getattr(star, name)
        zoneless = [c for c, kind in frame.dtypes if kind == "timestamp_ntz"]
        frame = frame.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})
        if name == "fact_orders":
            layout = ["order_timestamp", "order_id", "customer_id"]
            frame = frame.repartitionByRange(files, *layout).sortWithinPartitions("order_timestamp")
        frame.write.mode("overwrite").parquet(f"{root}/{name}")


def save_mart(frame: DataFrame, table: str, partition_by: list[str] | None = None) -> DataFrame:
    """Create or replace a managed table and return it as a frame."""
    writer = frame.write.mode("overwrite").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(table)
    return frame.sparkSession.table(table)


def save_bucketed(frame: DataFrame, table: str, key: str, buckets: int) -> DataFrame:
    """Store a table bucketed and sorted by ``key``.

    Orders, deliveries and ratings stored this way with the same number of buckets join on
    the order without a shuffle, in every mart that links them.
    """
    frame.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return frame.sparkSession.table(table)


def drop_mart(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")


def export_csv(frames: dict[str, DataFrame], directory: str, single: bool = True) -> dict[str, str]:
    """Write each frame as CSV with a header; returns the paths.

    Reports become one file ``<directory>/<name>.csv`` each, rows in the order of the frame: an
    executor writes it into a folder of its own, from which it is renamed, so a reader finds the old
    file or the whole new one. With ``single`` off, frames of any size become folders
    ``<directory>/<name>`` of part files. The jobs run side by side, as the last stages of small
    reports leave most executors idle.
    """

    def write(name: str) -> tuple[str, str]:
        frame, path = frames[name], f"{directory.rstrip('/')}/{name}"
        if not single:
            frame.write.mode("overwrite").option("header", True).csv(path)
            return name, path
        files = FileSystem(frame.sparkSession)
        folder = f"{path}-{uuid.uuid4().hex}"
        try:
            # The sorted partitions one after the other.
            frame.coalesce(1).write.option("header", True).csv(folder)
            (part,) = files.files(folder)
            files.swap(part, f"{path}.csv")
        finally:
            files.delete(folder)
        return name, f"{path}.csv"

    with ThreadPoolExecutor(max(1, len(frames))) as pool:
        return dict(pool.map(write, frames))
