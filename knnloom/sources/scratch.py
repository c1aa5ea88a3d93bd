"""Paths for files that a query writes and reads back."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, suffix: str = "") -> str:
    """A new path in the shared folder of spark.checkpoint.dir (unset, in local mode: a temporary one); it goes when the driver ends."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.gettempdir()
    folder = f"{at.rstrip('/')}/knnloom-scratch"
    if "://" not in folder and not folder.startswith("file:"):
        os.makedirs(folder, exist_ok=True)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f"{uuid.uuid4().hex}{suffix}")
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path.getParent())
    store.deleteOnExit(path)
    return path.toString()


_KEPT: list[str] = []


def kept(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table of its own in the shared folder, which cuts the lineage; it goes when the driver ends, or by ``drop_kept``."""
    path = scratch(df.sparkSession, ".parquet")
    df.write.parquet(path)
    _KEPT.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_tables() -> int:
    """How many tables ``kept`` has made that are still there."""
    return len(_KEPT)


def drop_kept(spark: SparkSession, first: int) -> None:
    """Removes the tables from number ``first`` on, once nothing reads them."""
    for path in _KEPT[first:]:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    del _KEPT[first:]
