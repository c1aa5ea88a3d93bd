"""Files of any store that pyarrow reaches."""

from __future__ import annotations

from pyarrow import fs


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


def open_file(path: str):
    store, inner = store_of(path)
    return store.open_input_file(inner)
