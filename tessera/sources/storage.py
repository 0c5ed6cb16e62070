"""Small files and folders on whatever file system Spark reads."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Storage:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark._jvm
        self.root = root.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()

    def path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def fs(self, path):
        return path.getFileSystem(self.conf)

    def exists(self, *parts: str) -> bool:
        p = self.path(*parts)
        return self.fs(p).exists(p)

    def names(self, *parts: str) -> list[str]:
        p = self.path(*parts)
        fs = self.fs(p)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, *parts: str) -> str:
        p = self.path(*parts)
        stream = self.fs(p).open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, text: str, *parts: str) -> None:
        """Write a new file; it appears as a whole or not at all."""
        p = self.path(*parts)
        fs, temporary = self.fs(p), self.path(*parts[:-1], f".{parts[-1]}.{uuid.uuid4().hex}")
        stream = fs.create(temporary)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not fs.rename(temporary, p):
            fs.delete(temporary, False)
            raise FileExistsError(str(p))

    def rename(self, old: str, new: str) -> None:
        if not self.fs(self.path(old)).rename(self.path(old), self.path(new)):
            raise FileExistsError(new)

    def delete(self, *parts: str) -> None:
        p = self.path(*parts)
        self.fs(p).delete(p, True)
