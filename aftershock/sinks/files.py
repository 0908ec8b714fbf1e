"""What the sinks ask of the Hadoop file system: any store that Spark reaches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class FileSystem:
    """Files under any path Spark can write, through the session's own configuration."""

    spark: SparkSession

    @property
    def _hadoop(self):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs

    @property
    def _conf(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        place = self._hadoop.Path(path)
        return place, place.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        place, system = self._at(path)
        return system.exists(place)

    def folders(self, path: str) -> list[str]:
        """Full paths of the folders in a folder; none where it does not exist."""
        place, system = self._at(path)
        if not system.exists(place):
            return []
        return sorted(str(s.getPath().toString()) for s in system.listStatus(place) if s.isDirectory())

    def files(self, path: str) -> dict[str, tuple[int, int]]:
        """Size and time of change of all data files below a folder, by full path."""
        place, system = self._at(path)
        found: dict[str, tuple[int, int]] = {}
        if not system.exists(place):
            return found
        listing = system.listFiles(place, True)
        while listing.hasNext():
            status = listing.next()
            if not status.getPath().getName().startswith(("_", ".")):
                found[status.getPath().toString()] = (status.getLen(), status.getModificationTime())
        return found

    def read_text(self, path: str) -> str:
        place, system = self._at(path)
        stream = system.open(place)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        place, system = self._at(path)
        stream = system.create(place, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def swap(self, new: str, path: str) -> None:
        """Put the file ``new`` in the place of ``path``, in one step: readers see the old or the new one."""
        hadoop = self._hadoop
        rename = getattr(hadoop, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        target = hadoop.Path(path)
        context = hadoop.FileContext.getFileContext(target.getFileSystem(self._conf).makeQualified(target).toUri(), self._conf)
        context.rename(hadoop.Path(new), target, options)

    def delete(self, path: str) -> None:
        place, system = self._at(path)
        system.delete(place, True)
