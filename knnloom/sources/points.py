"""Point files: text, binary, Parquet.

Text: ``id x y`` in turn, separated by white space of any kind (``tokens``).  Binary: a count of 8 bytes,
then that many records of 24 bytes (id as uint64, x and y as float64), little
endian.  Both are checked as they are read: a malformed token or a file whose
length doesn't fit its count is an error.

Binary parts (``.bins``): a folder of such files, written by the tasks, with a list
of those that count and their records, written as the job commits.  Files of
attempts that failed aren't in the list, and a folder without a list is an error.
"""

from __future__ import annotations

import json
import struct
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .stores import open_file, store_of
from .tokens import read_tokens

SCHEMA = "id bigint, x double, y double"
#: Fixed values of the binary format.
RECORD = np.dtype([("id", "<u8"), ("x", "<f8"), ("y", "<f8")])
HEADER = struct.Struct("<Q")
#: Records in one partition of a binary file, and in a file of a folder of parts; a task holds as many as it writes one.
SPLIT_RECORDS, PART_RECORDS = 4_000_000, 1_000_000
#: The list of a folder's parts.
LIST = "_parts.json"


class Split(InputPartition):
    def __init__(self, path: str, first: int, count: int) -> None:
        self.path, self.first, self.count = path, first, count


def _parts(path: str) -> list[tuple[str, int]] | None:
    """(path, records) of the parts of a folder; None for a file."""
    store, inner = store_of(path)
    if store.get_file_info(inner).type != fs.FileType.Directory:
        return None
    if store.get_file_info(f"{inner}/{LIST}").type != fs.FileType.File:
        raise ValueError(f"{path}: a folder without a list of its parts; its writing didn't end")
    with store.open_input_stream(f"{inner}/{LIST}") as f:
        return [(f"{path}/{name}", n) for name, n in json.loads(f.read())]


class BinaryPoints(DataSource):
    """``spark.read.format("points_bin")``: a binary point file, split by ranges of records."""

    @classmethod
    def name(cls) -> str:
        return "points_bin"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BinaryPointsReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return BinaryPointsWriter(self.options["path"])


def _count(path: str) -> int:
    """The records of a file, by its header, if its length fits."""
    with open_file(path) as f:
        size = f.size()
        count = HEADER.unpack(f.read(HEADER.size))[0] if size >= HEADER.size else -1
    if size != HEADER.size + RECORD.itemsize * count:
        raise ValueError(f"{path}: {size} bytes don't hold the records that its header counts")
    return count


@dataclass
class Written(WriterCommitMessage):
    parts: list[tuple[str, int]]


class BinaryPointsWriter(DataSourceArrowWriter):
    """Tasks write parts with counts of their own; the driver lists those of the attempts that Spark committed."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, inner = store_of(self.path)
        store.create_dir(inner, recursive=True)
        parts: list[tuple[str, int]] = []

        def part(held: list[np.ndarray]) -> None:
            rows = np.concatenate(held)
            name = f"part-{uuid.uuid4().hex}.bin"
            with store.open_output_stream(f"{inner}/{name}") as f:
                f.write(HEADER.pack(len(rows)))
                f.write(rows.tobytes())
            parts.append((name, len(rows)))

        held, n = [], 0
        for batch in iterator:
            rows = _records(batch)
            while n + len(rows) >= PART_RECORDS:
                first, rows = rows[: PART_RECORDS - n], rows[PART_RECORDS - n :]
                part([*held, first])
                held, n = [], 0
            held.append(rows)
            n += len(rows)
        if n:
            part(held)
        return Written(parts)

    def commit(self, messages: list[Written | None]) -> None:
        store, inner = store_of(self.path)
        store.create_dir(inner, recursive=True)
        with store.open_output_stream(f"{inner}/{LIST}") as f:
            f.write(json.dumps([p for m in messages if m for p in m.parts]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, inner = store_of(self.path)
        for m in messages:
            for name, _ in m.parts if m else ():
                store.delete_file(f"{inner}/{name}")


class BinaryPointsReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Split]:
        parts = _parts(self.path)
        if parts is not None:  # each is checked as it is read
            return [Split(path, 0, n) for path, n in parts] or [Split("", 0, 0)]
        count = _count(self.path)
        return [Split(self.path, a, min(SPLIT_RECORDS, count - a)) for a in range(0, count, SPLIT_RECORDS)] or [Split("", 0, 0)]

    def read(self, split: Split):
        if not split.path:
            return
        if split.first + split.count > _count(split.path):
            raise ValueError(f"{split.path}: fewer records than are listed")
        with open_file(split.path) as f:
            f.seek(HEADER.size + split.first * RECORD.itemsize)
            left = split.count
            while left:
                rows = np.frombuffer(f.read(min(left, 65_536) * RECORD.itemsize), RECORD)
                left -= len(rows)
                if (rows["id"] >> np.uint64(63)).any():
                    raise ValueError(f"{split.path}: an id of 2^63 or more")
                yield pa.RecordBatch.from_arrays([pa.array(rows["id"].astype(np.int64)), pa.array(rows["x"].copy()), pa.array(rows["y"].copy())], ["id", "x", "y"])


def read_points(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """(id, x, y) of a point file; the format goes by the suffix (.bin or .bins, .parquet, else text)."""
    fmt = fmt or ("bin" if path.endswith((".bin", ".bins")) else "parquet" if path.endswith(".parquet") else "text")
    if fmt == "parquet":
        return spark.read.parquet(path).select("id", "x", "y")
    if fmt in ("bin", "bins"):
        spark.dataSource.register(BinaryPoints)
        return spark.read.format("points_bin").load(path)
    return read_tokens(spark, path)


def load_points(spark: SparkSession, queries: str, candidates: str) -> tuple[DataFrame, DataFrame, float]:
    """Both point files, read into Spark's storage (memory, then disk), and the seconds that took."""
    began = time.perf_counter()
    both = [read_points(spark, path).persist() for path in (queries, candidates)]
    for df in both:
        df.count()
    return both[0], both[1], time.perf_counter() - began


def _records(batch: pa.RecordBatch) -> np.ndarray:
    """A batch of points as records of the binary format."""
    rows = np.empty(batch.num_rows, RECORD)
    for c in RECORD.names:
        col = batch.column(batch.schema.get_field_index(c))
        if col.null_count:
            raise ValueError(f"a point without {c}")
        rows[c] = col.to_numpy(zero_copy_only=False)
    return rows


def _joined(parts: str, path: str) -> int:
    """Writes the records of a folder's parts to one file; how many they are."""
    listed = _parts(parts)
    store, inner = store_of(path)
    with store.open_output_stream(inner) as out:
        out.write(HEADER.pack(sum(n for _, n in listed)))
        for name, _ in listed:
            with open_file(name) as f:
                f.seek(HEADER.size)
                while block := f.read(1 << 22):
                    out.write(block)
    return sum(n for _, n in listed)


def _as_one_file(spark: SparkSession, parts: str, path: str) -> None:
    """A task puts a folder's parts together as one file, with the sum of their counts in front."""

    def copied(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_joined(parts, path)])], ["n"])

    spark.range(0, 1, 1, 1).mapInArrow(copied, "n bigint").collect()


#: Digits of text points, and of thinned ones.
DIGITS, THIN_DIGITS = 8, 10


def write_points(points: DataFrame, path: str, fmt: str | None = None, digits: int = DIGITS) -> None:
    """Writes (id, x, y) as Parquet, as text of a fixed number of digits, or as binary records.

    The format goes by the suffix: .bins is a folder of parts, .bin one file, which
    a task makes of such parts; no record passes the driver.
    """
    fmt = fmt or next((f for f in ("bin", "bins", "parquet") if path.endswith(f".{f}")), "text")
    if fmt == "parquet":
        points.select("id", "x", "y").write.parquet(path)
    elif fmt == "text":
        points.select(F.format_string(f"%d\t%.{digits}f\t%.{digits}f", "id", "x", "y").alias("value")).write.text(path)
    else:
        spark = points.sparkSession
        spark.dataSource.register(BinaryPoints)
        parts = path if fmt == "bins" else f"{path}-{uuid.uuid4().hex}.bins"
        store, inner = store_of(path)
        if store.get_file_info(inner).type != fs.FileType.NotFound:
            raise ValueError(f"{path} is there already")
        points.select(*(F.col(c).cast(t) for c, t in (f.split() for f in SCHEMA.split(", ")))).write.format("points_bin").mode("append").save(parts)
        if fmt == "bin":
            _as_one_file(spark, parts, path)
            store, inner = store_of(parts)
            store.delete_dir(inner)
