"""The shared folder that lineage is cut in."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one file that a place can number.
_FILE_BITS = 40
_PATHS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, in local mode only (as in tests), a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = os.path.join(tempfile.gettempdir(), "knnloom-checkpoints")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def pinned(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """The rows written as a Parquet table in the shared folder, and read from it.

    Cuts the lineage like checkpoint(), in columns.  Tables of keys and hashes
    don't compress: "none" saves them the codec and its buffers.  The table goes
    when the driver ends.
    """
    path = f"{shared_dir(df.sparkSession)}/pinned-{uuid.uuid4().hex}"
    _PATHS.append(path)
    df.write.option("compression", compression).parquet(path)
    context = df.sparkSession.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(at)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tables() -> int:
    """How many tables this process has pinned."""
    return len(_PATHS)


def drop_tables(first: int, keep: DataFrame) -> None:
    """Removes the pinned tables from number ``first`` on that ``keep`` doesn't read, once nothing else does."""
    read = "\n".join(keep.inputFiles())
    context = keep.sparkSession.sparkContext
    for path in _PATHS[first:]:
        if os.path.basename(path) not in read:
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def _file_and_row(docs: DataFrame) -> tuple:
    """The file and the row in it, hidden columns of a scan of files, whatever its other columns are called."""
    hidden = docs.metadataColumn("_metadata")
    return hidden["file_path"].alias("__file"), hidden["row_index"].alias("__row")


def _scans_files(docs: DataFrame) -> bool:
    """Whether the rows are those of files, at most filtered and projected."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation":
        return False
    try:
        docs.select(*_file_and_row(docs)).schema  # noqa: B018
    except AnalysisException:
        return False
    return True


def placed(docs: DataFrame, name: str) -> DataFrame:
    """The rows with a number (bigint) as last column: the file's place by path, then the row's in the file.

    Any scan gives a row the same number, however files are packed into
    partitions, so it may be joined and counted against itself on a cluster that
    grows or shrinks meanwhile.  What isn't read from files is pinned first.
    One path a file comes to the driver and is broadcast, as for the scan itself.
    """
    docs = docs if _scans_files(docs) else pinned(docs)
    paths = sorted(r[0] for r in docs.select(_file_and_row(docs)[0]).distinct().collect())
    files = docs.sparkSession.createDataFrame([(p, i << _FILE_BITS) for i, p in enumerate(paths)], "__path string, __base bigint")
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns), *_file_and_row(docs))
    found = rows.join(F.broadcast(files), F.col("__file") == F.col("__path"))
    place = F.coalesce(F.col("__base") + F.col("__row"), F.lit(-1))  # never null, so that joins of any kind read the same rows
    return found.select(*(F.col(f"`{c}`") for c in docs.columns), place.alias(name))
