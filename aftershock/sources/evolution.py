"""Tables whose columns have changed their type, read without rewriting older files.

A log beside the data says which types columns had, and which files were there when a type changed. Each
group of files is read with the types it was written in and cast to the last ones, so the change
itself costs nothing and the scan still prunes columns and row groups.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aftershock.sinks.files import FileSystem

# Readers of Parquet folders pass over names that begin like this.
LOG = "_types.json"


class EvolvingTable:
    """A folder of Parquet files with a log of its types."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.files = FileSystem(spark)

    def _log(self) -> list[dict]:
        """Types with the files written in them, in order; files that no entry names have the last types."""
        return json.loads(self.files.read_text(f"{self.folder}/{LOG}"))

    def _store(self, log: list[dict]) -> None:
        new = f"{self.folder}/_new-{uuid.uuid4().hex}.json"
        self.files.write_text(new, json.dumps(log))
        self.files.swap(new, f"{self.folder}/{LOG}")

    def begin(self, schema: T.StructType) -> None:
        """Start the log of a folder whose files, if there are any, have these types."""
        self._store([{"schema": schema.jsonValue(), "files": []}])

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self._log()[-1]["schema"])

    def append(self, frame: DataFrame) -> None:
        """Add rows, in the table's present types."""
        want = {f.name: f.dataType for f in self.schema}
        have = {f.name: f.dataType for f in frame.schema}
        if want != have:
            raise ValueError(f"the table has {want}, the rows have {have}")
        frame.write.mode("append").parquet(self.folder)

    def alter(self, **types: str) -> None:
        """Give columns new types from now on. Files stay; values that do not fit fail on reading, see :meth:`misfits`."""
        log = self._log()
        schema = self.schema
        unknown = types.keys() - set(schema.names)
        if unknown:
            raise ValueError(f"no such columns: {sorted(unknown)}")
        known = {path for entry in log for path in entry["files"]}
        log[-1]["files"] = sorted(self.files.files(self.folder).keys() - known)
        changed = [T.StructField(f.name, T.DataType.fromDDL(types[f.name]) if f.name in types else f.dataType) for f in schema]
        log.append({"schema": T.StructType(changed).jsonValue(), "files": []})
        self._store(log)

    def _parts(self) -> list[tuple[DataFrame, T.StructType]]:
        """The frame of each group of files in the types it was written in."""
        log = self._log()
        found = self.files.files(self.folder)
        known = {path for entry in log for path in entry["files"]}
        parts = []
        for entry in log:
            schema = T.StructType.fromJson(entry["schema"])
            own = [p for p in entry["files"] if p in found] if entry is not log[-1] else sorted(found.keys() - known)
            if own:
                parts.append((self.spark.read.schema(schema).parquet(*own), schema))
        return parts

    def read(self) -> DataFrame:
        """All rows in the present types. A value that does not fit its new type ends the query."""
        schema = self.schema
        frames = [
            part.select(*[F.col(f.name) if f.dataType == own[f.name].dataType else _strict(f) for f in schema])
            for part, own in self._parts()
        ]
        if not frames:
            return self.spark.createDataFrame([], schema)
        return reduce(DataFrame.unionByName, frames)

    def misfits(self) -> DataFrame:
        """Rows (column, old_type, new_type, values, misfits): how many known values have no place in the new type."""
        schema, counts = self.schema, []
        for part, own in self._parts():
            for f in schema:
                old = own[f.name].dataType
                if f.dataType != old:
                    lost = F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()
                    counts.append(
                        part.agg(
                            F.lit(f.name).alias("column"),
                            F.lit(old.simpleString()).alias("old_type"),
                            F.lit(f.dataType.simpleString()).alias("new_type"),
                            F.count(f.name).alias("values"),
                            F.count(F.when(lost, 1)).alias("misfits"),
                        )
                    )
        if not counts:
            return self.spark.createDataFrame([], "column string, old_type string, new_type string, values long, misfits long")
        return reduce(DataFrame.unionByName, counts)


def _strict(field: T.StructField):
    """The column in its new type; a known value that would become NULL raises."""
    value = F.col(field.name)
    cast = value.try_cast(field.dataType)
    message = F.concat(F.lit(f"{field.name} does not fit {field.dataType.simpleString()}: "), value.cast("string"))
    misfit = value.isNotNull() & cast.isNull()
    return F.when(misfit, F.raise_error(message).cast(field.dataType)).otherwise(cast).alias(field.name)
