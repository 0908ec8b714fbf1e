"""Marts in versions: period folders, and one pointer that says which of them count.

A build writes new folders only, never into one that readers may be using, and becomes visible
for all marts at once when its pointer file takes the place of the old one. A build that
fails leaves every mart as it was. Folders of the same period from older builds stay until
:meth:`MartStore.vacuum`, so a frame that was read before a build goes on working.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection
from concurrent.futures import ThreadPoolExecutor
from copy import deepcopy
from functools import partial
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aftershock.sinks.files import FileSystem

PERIOD = "stored_period"
WHOLE = "all"
# Folders that the driver lists by itself.
LISTING, LISTED = "spark.sql.sources.parallelPartitionDiscovery.threshold", 2000
# Marts written side by side; the last stages of small ones leave most executors idle.
WRITERS = 6


class MartStore:
    """The marts under ``root`` as the last published build left them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.files = FileSystem(spark)

    @property
    def pointer(self) -> str:
        return f"{self.root}/current.json"

    def state(self) -> dict:
        """Build number, folders of every mart by period, and what the build was told to remember."""
        if not self.files.exists(self.pointer):
            return {"build": None, "marts": {}, "notes": {}}
        return json.loads(self.files.read_text(self.pointer))

    def names(self) -> list[str]:
        return sorted(self.state()["marts"])

    def read(self, name: str, periods: Collection[str] | None = None) -> DataFrame:
        """A mart, or those folders of it that hold the given periods; other folders are not opened."""
        return read_parts(self.spark, self.state()["marts"][name], periods)

    def begin(self) -> Build:
        return Build(self, self.state())

    def vacuum(self) -> list[str]:
        """Delete all folders that the published build does not use; returns them.

        Not while another build writes or frames of older builds are still being read.
        """
        used = {folder for mart in self.state()["marts"].values() for folder in mart["folders"].values()}
        gone = []
        for mart in self.files.folders(self.root):
            for build in self.files.folders(mart):
                unused = [f for f in self.files.folders(build) if f not in used]
                for folder in unused:
                    self.files.delete(folder)
                gone += unused
                if not self.files.folders(build):
                    self.files.delete(build)
        return gone


def read_parts(spark: SparkSession, mart: dict, periods: Collection[str] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(mart["schema"])
    folders = [f for period, f in sorted(mart["folders"].items()) if periods is None or period in periods]
    if not folders:
        return spark.createDataFrame([], schema)
    # Listing a folder per period takes the driver less time than the job Spark would start for it.
    before = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(max(int(before), LISTED)))
    try:
        return spark.read.schema(schema).parquet(*folders)
    finally:
        spark.conf.set(LISTING, before)


class Build:
    """New folders for some periods of some marts, unseen until :meth:`publish`."""

    def __init__(self, store: MartStore, base: dict):
        self.store = store
        self.id = uuid.uuid4().hex
        self.base = base["build"]
        self.marts: dict = deepcopy(base["marts"])
        self.notes: dict = deepcopy(base["notes"])

    def read(self, name: str, periods: Collection[str] | None = None) -> DataFrame:
        """A mart as this build will leave it."""
        return read_parts(self.store.spark, self.marts[name], periods)

    def replace(self, name: str, frame: DataFrame) -> None:
        """Give the whole mart new content."""
        self._write(name, frame.withColumn(PERIOD, F.lit(WHOLE)), None)

    def refresh(self, name: str, frame: DataFrame, period: Column, periods: Collection[str] | None) -> None:
        """Give the ``periods`` of a mart new content (all of it, if None); rows of other periods are left out.

        ``period`` is the text of a row's period. A period without rows loses its folder.
        """
        frame = frame.withColumn(PERIOD, period)
        if periods is not None:
            frame = frame.filter(F.col(PERIOD).isin(*sorted(periods)) if periods else F.lit(False))
        self._write(name, frame, periods)

    def refresh_all(self, marts: dict[str, tuple[DataFrame, Column, Collection[str] | None]]) -> None:
        """:meth:`refresh` for several marts, side by side."""
        with ThreadPoolExecutor(min(WRITERS, max(1, len(marts)))) as pool:
            for done in [pool.submit(partial(self.refresh, name, *mart)) for name, mart in marts.items()]:
                done.result()

    def _write(self, name: str, frame: DataFrame, periods: Collection[str] | None) -> None:
        folder = f"{self.store.root}/{name}/{self.id}-{uuid.uuid4().hex[:8]}"
        # Rows of a period come together in few files; AQE splits a period that is too large for one.
        frame.hint("rebalance", PERIOD).write.partitionBy(PERIOD).parquet(folder)
        written = {unquote(f.rsplit("=", 1)[1]): f for f in self.store.files.folders(folder)}
        old = self.marts.get(name, {"folders": {}})["folders"]
        kept = {} if periods is None else {p: f for p, f in old.items() if p not in periods}
        schema = T.StructType([f for f in frame.schema.fields if f.name != PERIOD])
        self.marts[name] = {"schema": json.loads(schema.json()), "folders": kept | written}

    def publish(self) -> None:
        """Make the build what readers see. Refused if another build was published since this one began."""
        if self.store.state()["build"] != self.base:
            raise RuntimeError("another build has been published meanwhile")
        state = {"build": self.id, "marts": self.marts, "notes": self.notes}
        new = f"{self.store.root}/next-{self.id}.json"
        self.store.files.write_text(new, json.dumps(state))
        self.store.files.swap(new, self.store.pointer)
