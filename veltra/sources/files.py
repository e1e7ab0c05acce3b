"""Files through Hadoop's API, so every store that Spark reaches works alike."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def list(self, name: str = "") -> list[str]:
        p = self.path(name)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, name: str, data: bytes) -> bool:
        """Write a file whole or not at all; False if it exists already."""
        if self.fs.exists(self.path(name)):
            return False
        temporary = self.path(f"{name}.tmp-{self.jvm.java.util.UUID.randomUUID().toString()}")
        stream = self.fs.create(temporary, False)
        stream.write(bytearray(data))
        stream.close()
        done = self.fs.rename(temporary, self.path(name))
        if not done:
            self.fs.delete(temporary, False)
        return done

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def remove(self, name: str) -> bool:
        return self.fs.delete(self.path(name), True)
