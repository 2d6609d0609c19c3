"""The shared work folder, and small files on any Hadoop file system."""

from __future__ import annotations

import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def work_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; on a local master without that setting a folder of this machine."""
    for value in (spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.getCheckpointDir()):
        if value:
            return value.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexsieve-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Folder:
    """A folder on the file system of its path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.jvm = spark, spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(""))) if self.exists() else []

    def size(self, name: str = "") -> int:
        return self.fs.getContentSummary(self._path(name)).getLength() if self.exists(name) else 0

    def delete(self, name: str = "") -> bool:
        return self.fs.delete(self._path(name), True)

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def age(self, name: str = "") -> float | None:
        """Seconds since a file or folder was changed; None if there is none."""
        try:
            return max(0.0, time.time() - self.fs.getFileStatus(self._path(name)).getModificationTime() / 1000)
        except Py4JJavaError:
            return None

    def create(self, name: str, text: str = "") -> bool:
        """Create a file, unless it is there; whether it was created."""
        try:
            stream = self.fs.create(self._path(name), False)
        except Py4JJavaError:
            return False
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def publish(self, name: str, text: str) -> None:
        """Write a file under another name, then put it in place by one rename that overwrites."""
        new = self._path(f".{name}.{uuid.uuid4().hex}")
        stream = self.fs.create(new, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.fs.makeQualified(new), self.fs.makeQualified(self._path(name)), how)
