"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, whose tasks run on this
    machine, gets a folder of its own where that is unset; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    if not _written:
        atexit.register(release)
    path = f"{shared_dir(spark)}/tessera-scratch/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    return path


def written() -> set[str]:
    """The paths given out and not released yet."""
    return set(_written)


def release(paths: Iterable[str] | None = None) -> None:
    """Delete the tables at these paths, or all of them, as far as their session still lives."""
    for path in list(_written if paths is None else paths):
        spark = _written.pop(path, None)
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended; the folder is scratch space
            pass


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df written as Parquet and read back: what builds on it neither repeats its plan nor loses it with an executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
