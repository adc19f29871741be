"""Directory operations on any file system Spark can write to."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Folder:
    """A directory, reached through the Hadoop file system of its URI."""

    def __init__(self, spark: SparkSession, uri: str):
        self._jvm = spark._jvm
        self.uri = uri.rstrip("/")
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{name}" if name else self.uri)

    def path(self, name: str) -> str:
        return f"{self.uri}/{name}"

    def make(self) -> None:
        self._fs.mkdirs(self._path())

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def _names(self, name: str, directories: bool) -> list[str]:
        if not self._fs.exists(self._path(name)):
            return []
        listed = self._fs.listStatus(self._path(name))
        return sorted(s.getPath().getName() for s in listed if s.isDirectory() == directories)

    def subfolders(self, name: str) -> list[str]:
        return self._names(name, True)

    def files(self, name: str) -> list[str]:
        return self._names(name, False)

    def write_once(self, name: str, content: dict) -> None:
        """Create a small file; fails when it exists already."""
        stream = self._fs.create(self._path(name), False)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()

    def read(self, name: str) -> dict:
        stream = self._fs.open(self._path(name))
        try:
            lines = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(lines)

    def bytes(self, name: str) -> int:
        """Size of everything below a directory."""
        return self._fs.getContentSummary(self._path(name)).getLength()

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
