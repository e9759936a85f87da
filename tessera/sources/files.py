"""Small control files in any file system that Spark reaches, through Hadoop's API."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a new file whole; False if the name is taken. The text goes to a file of its own first and takes the
        name in one step that fails if there is one: a hard link on a local disk, elsewhere a rename, which HDFS refuses
        onto an existing file. Object stores without such a rename need another commit service."""
        at, part = self._at(name), self._at(f"{name}.{uuid.uuid4().hex}.part")
        self.fs.mkdirs(at.getParent())
        stream = self.fs.create(part, False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
            stream.hsync()
        finally:
            stream.close()
        try:
            if self.fs.getUri().getScheme() == "file":
                try:
                    os.link(part.toUri().getPath(), at.toUri().getPath())
                except FileExistsError:
                    return False
                return True
            return not self.fs.exists(at) and bool(self.fs.rename(part, at))
        finally:
            self.fs.delete(part, False)

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)
