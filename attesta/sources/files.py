"""Small files next to tables, on any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Folder:
    """Files of a folder by name, through Hadoop's file system interface."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm = spark.sparkContext._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.path = path
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self) -> list[str]:
        return [f.getPath().getName() for f in self._fs.listStatus(self._at(""))] if self.exists() else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Write a file in UTF-8, in place of one of that name."""
        stream = self._fs.create(self._at(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def create(self, name: str, text: str, draft: str) -> bool:
        """Write a file of that name unless there is one; says whether it did. It appears whole, under its final name, or not at all: it is written as
        ``draft`` and renamed without overwriting, so of several writers one succeeds."""
        self.write(draft, text)
        fs = self._jvm.org.apache.hadoop.fs
        plain = self._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        try:
            fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._fs.makeQualified(self._at(draft)), self._fs.makeQualified(self._at(name)), plain)
        except Exception:
            # Only a file of that name is a reason to go on.
            if not self.exists(name):
                raise
            self.delete(draft)
            return False
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
