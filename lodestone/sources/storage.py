"""Files and folders on whatever file system Spark reads and writes: local, HDFS or an object store. Driver side."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


class Place:
    """A path; without a scheme it lies on Spark's default file system, as it does for Spark's readers and writers."""

    def __init__(self, spark: SparkSession, path: str | Path):
        self.spark, self.uri = spark, str(path)
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = self._hadoop.Path(self.uri)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())

    def __str__(self) -> str:
        return self.uri

    def __truediv__(self, name: str) -> Place:
        return Place(self.spark, f"{self.uri.rstrip('/')}/{name}")

    @property
    def name(self) -> str:
        return self._path.getName()

    def qualified(self) -> str:
        """The path with its scheme, as tasks need it."""
        found = self._fs.makeQualified(self._path).toString()
        return f"file://{found.removeprefix('file:')}" if found.startswith("file:/") and not found.startswith("file://") else found

    def exists(self) -> bool:
        return self._fs.exists(self._path)

    def children(self) -> list[Place]:
        return [Place(self.spark, s.getPath().toString()) for s in self._fs.listStatus(self._path)] if self.exists() else []

    def size(self) -> int:
        return self._fs.getContentSummary(self._path).getLength() if self.exists() else 0

    def remove(self) -> None:
        self._fs.delete(self._path, True)

    def read_text(self) -> str:
        stream = self._fs.open(self._path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_text(self, text: str) -> None:
        """Replace the file as a whole: readers see the old text or the new one (where the file system's rename is atomic)."""
        draft = Place(self.spark, f"{self.uri}.{uuid.uuid4().hex}")
        stream = self._fs.create(draft._path, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self._hadoop.FileContext.getFileContext(self._path.toUri(), self.spark._jsc.hadoopConfiguration())
        option = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = option
        context.rename(self._fs.makeQualified(draft._path), self._fs.makeQualified(self._path), options)


def scratch(spark: SparkSession) -> Place:
    """The folder that the whole cluster shares: spark.checkpoint.dir. Only a session on one machine may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    return Place(spark, named or "file:///tmp/checkpoints/lodestone")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the scratch folder: what it cost is paid once, also when executors are lost. The folder's owner clears it."""
    place = scratch(df.sparkSession) / f"{name}-{uuid.uuid4().hex}"
    df.write.parquet(str(place))
    return df.sparkSession.read.schema(df.schema).parquet(str(place))
