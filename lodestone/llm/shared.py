"""Intermediate tables and files in the folder that the whole cluster shares.

Lineage is cut only by tables written there, never by executor-local copies, so a lost executor
costs the recomputation of its tasks and nothing else.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import time
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import vec
from lodestone.sources.storage import Place

#: Used only where the session names no folder, as in tests on one machine.
DEFAULT_DIR = "file:///tmp/checkpoints/lodestone"
_paths: dict[int, tuple[DataFrame, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI: spark.checkpoint.dir. Where that is unset, DEFAULT_DIR on a single machine; a cluster must name its folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        found = DEFAULT_DIR
        spark.conf.set("spark.checkpoint.dir", found)
    return Place(spark, found).qualified()  # without a scheme it lies on Spark's default file system


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh URI under the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, path)
    return path


def remove(path: str) -> None:
    """Delete a table or folder made by new_path()."""
    fs, inner = filesystem(path)
    with contextlib.suppress(OSError):
        fs.delete_dir(inner)


def filesystem(path: str):
    """(pyarrow file system, path inside it) of a URI; works on driver and executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def table(df: DataFrame, name: str, compression: str = "snappy", **options: str) -> DataFrame:
    """Write df once as a shared Parquet table, with the writer's options, and read it back; forget() deletes it before the driver ends."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(compression=compression, **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = out, path
    return out


def remove_table(df: DataFrame) -> None:
    """Delete a table made by table(), all of whose readers are done."""
    remove(_paths.pop(id(df))[1])


def forget(*tables: DataFrame) -> None:
    """Delete tables made by table() whose readers are all done, and let Spark's cleaner free the shuffle files of finished jobs."""
    for df in tables:
        remove_table(df)
    if (context := SparkContext._active_spark_context) is not None:
        for _ in range(2):  # shuffle files go with the driver's handles to them, some of which the first collection only lets go
            gc.collect()
            context._jvm.System.gc()
            time.sleep(0.3)
    vec.release()


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not have, whatever the letter case."""
    have = {c.lower() for c in df.columns}
    while base.lower() in have:
        base += "_"
    return base
