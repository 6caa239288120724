"""Folders of a table with a log of versions: what a version holds is a small JSON document, and a commit is creating the next one.

Data files are never changed; a version names the folders that are part of
it.  Two writers can't commit the same version, as its file is created only
if there is none (atomic on HDFS and POSIX file systems).
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Folder:
    """A path with the few file operations that tables with versions need, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._hadoop("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _hadoop(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        """What lies in a folder, sorted; nothing if there is none."""
        there = self._hadoop(name)
        if not self._fs.exists(there):
            return []
        return sorted(status.getPath().getName() for status in self._fs.listStatus(there))

    def create(self, name: str, text: str) -> None:
        """A new file; an error if there is one."""
        out = self._fs.create(self._hadoop(name), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def text(self, name: str) -> str:
        stream = self._fs.open(self._hadoop(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._fs.delete(self._hadoop(name), True)


class VersionLog:
    """The versions of a table under ``path``: ``_log/<number>.json``, and ``data`` beside it."""

    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)

    def latest(self) -> tuple[int, dict]:
        """The newest version's number and content; (0, {}) if there is none."""
        numbers = [int(n[:-5]) for n in self.folder.names("_log") if n.endswith(".json") and not n.startswith(".")]
        if not numbers:
            return 0, {}
        return max(numbers), json.loads(self.folder.text(f"_log/{max(numbers):020d}.json"))

    def commit(self, number: int, content: dict) -> None:
        self.folder.create(f"_log/{number:020d}.json", json.dumps(content, sort_keys=True))

    def data(self, name: str) -> str:
        return f"{self.folder.path}/data/{name}"

    def vacuum(self, used: set[str]) -> list[str]:
        """Delete the folders of ``data`` that the newest version doesn't name; readers of older versions must be done."""
        gone = [n for n in self.folder.names("data") if n not in used]
        for name in gone:
            self.folder.delete(f"data/{name}")
        return gone
