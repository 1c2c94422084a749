"""Small files on whatever file system a path names, through Hadoop's API, so that a cluster's shared storage works like a local disk."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway

    def _at(self, path: str | os.PathLike[str]):
        p = self._jvm.org.apache.hadoop.fs.Path(str(path))
        return p.getFileSystem(self._conf), p

    def exists(self, path) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def mkdirs(self, path) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def remove(self, path) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def names(self, path) -> list[str]:
        """What lies in a folder, hidden files aside, sorted."""
        fs, p = self._at(path)
        return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(p)) if n[0] not in "._")

    def read(self, path) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path, text: str) -> None:
        fs, p = self._at(path)
        stream = fs.create(p, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def publish(self, path, text: str, *, replace: bool = False) -> None:
        """The file appears whole. Unless it may ``replace`` another, an existing one is an error."""
        _, p = self._at(path)
        hidden = f"{p.getParent()}/.{p.getName()}.new"
        self.write(hidden, text)
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self._gateway.new_array(kind, 1)
        options[0] = kind.valueOf("OVERWRITE" if replace else "NONE")
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self._conf).rename(self._at(hidden)[1], p, options)
