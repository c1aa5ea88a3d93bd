"""Text points as a stream of tokens: ``id x y`` in turn, separated by any white space, line ends included.

Files are split by bytes.  A token belongs to the split it begins in, a point to the
split of its id.  Which token of a split begins a point follows from the number of
tokens before it: a first pass counts them, one number a split comes to the driver.
A task reads on past its split to end its last point.  A token that isn't a number,
or a file that ends within a point, is an error that names the file and the byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from .stores import open_file, store_of

#: Bytes of a split, and bytes that are read at once.
SPLIT_BYTES, BLOCK_BYTES = 64 << 20, 4 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of a folder's files but hidden ones, by name."""
    store, inner = store_of(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"path does not exist: {path}")
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    inside = [f for f in store.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return [(f"{path.rstrip('/')}/{f.base_name}", f.size) for f in sorted(inside, key=lambda f: f.base_name)]


def blocks(path: str, begin: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of whole tokens, from the first that begins at ``begin`` or later on."""
    with open_file(path) as f:
        base = max(begin - 1, 0)
        f.seek(base)
        tail, inside = b"", begin > 0  # inside: perhaps within a token of the split before
        while True:
            block = f.read(BLOCK_BYTES)
            data = tail + block
            if inside:
                at = np.flatnonzero(_SPACE[np.frombuffer(data, np.uint8)])
                if not len(at) and block:
                    base, tail = base + len(data), b""
                    continue
                skip = int(at[0]) if len(at) else len(data)
                base, data, inside = base + skip, data[skip:], False
            if not block:
                if data:
                    yield base, data
                return
            at = np.flatnonzero(_SPACE[np.frombuffer(data, np.uint8)])
            cut = int(at[-1]) + 1 if len(at) else 0
            if cut:
                yield base, data[:cut]
            base, tail = base + cut, data[cut:]


def bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where tokens begin and end."""
    space = np.r_[True, _SPACE[np.frombuffer(data, np.uint8)], True]
    turn = np.flatnonzero(space[1:] != space[:-1])
    return turn[::2], turn[1::2]


def count(path: str, begin: int, end: int) -> int:
    """Tokens that begin in [begin, end)."""
    n = 0
    for base, data in blocks(path, begin):
        if base >= end:
            break
        n += int(np.searchsorted(bounds(data)[0] + base, end))
    return n


def read(path: str, begin: int, end: int, before: int, first: int) -> Iterator[pa.RecordBatch]:
    """(id, x, y, place) of the points whose ids begin in [begin, end); ``first``: the place of the file's first point."""
    skip, place, held, at, done = -before % 3, first + (before + 2) // 3, [], [], False

    def batch() -> Iterator[pa.RecordBatch]:
        nonlocal held, at, place
        n = len(held) // 3
        if n:
            columns = []
            for i, kind in enumerate((pa.int64(), pa.float64(), pa.float64())):
                tokens = held[i : 3 * n : 3]
                try:
                    columns.append(pc.cast(pa.array(tokens, pa.binary()).cast(pa.string()), kind))
                except pa.ArrowInvalid:
                    columns.append(pa.array([number(t, kind, at[3 * j + i]) for j, t in enumerate(tokens)], kind))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(place, place + n))], ["id", "x", "y", "place"])
        held, at, place = held[3 * n :], at[3 * n :], place + n

    def number(token: bytes, kind: pa.DataType, offset: int) -> int | float:
        try:
            value = int(token) if kind == pa.int64() else float(token)
        except ValueError:
            value = None
        if value is None or kind == pa.int64() and not -(1 << 63) <= value < 1 << 63:
            raise ValueError(f"malformed point: {token[:40].decode(errors='replace')!r} at byte {offset} of {path}")
        return value

    for base, data in blocks(path, begin):
        starts, ends = bounds(data)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if base + a >= end and len(held) % 3 == 0:
                done = True
                break
            if skip and base + a < end:
                skip -= 1
                continue
            if skip:
                done = True
                break
            held.append(data[a:b])
            at.append(base + a)
        if done:
            break
        if len(held) > 100_000:
            yield from batch()
    yield from batch()
    if held:
        raise ValueError(f"malformed point: {path} ends within the point at byte {at[0]}")


def read_tokens(spark: SparkSession, path: str, place: bool = False) -> DataFrame:
    """(id, x, y) of a text file or a folder of them; with ``place``, also each point's place in the file (of a folder: its files one after another)."""
    splits, n = [], []
    for name, size in files(path):
        splits += [(name, a, min(a + SPLIT_BYTES, size)) for a in range(0, size, SPLIT_BYTES)]

    def counted(batches):
        for b in batches:
            rows = b.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([r["number"] for r in rows], pa.int64()), pa.array([count(r["path"], r["a"], r["b"]) for r in rows], pa.int64())], ["number", "n"])

    def points(batches):
        for b in batches:
            for r in b.to_pylist():
                yield from read(r["path"], r["a"], r["b"], r["before"], r["first"])

    rows = [(i, *s) for i, s in enumerate(splits)]
    table = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(max(1, min(len(rows), 10_000)), "number")
    if len(rows) > 1:
        found = dict(map(tuple, table(rows, "number bigint, path string, a bigint, b bigint").mapInArrow(counted, "number bigint, n bigint").collect()))
        n = [found[i] for i in range(len(rows))]
    placed, before, first = [], 0, 0
    for i, s in enumerate(splits):
        if i and s[0] != splits[i - 1][0]:  # another file
            before, first = 0, first + before // 3
        placed.append((i, *s, before, first))
        before += n[i] if n else 0
    schema = "number bigint, path string, a bigint, b bigint, before bigint, first bigint"
    out = table(placed, schema).mapInArrow(points, "id bigint, x double, y double, place bigint")
    return out if place else out.select("id", "x", "y")
