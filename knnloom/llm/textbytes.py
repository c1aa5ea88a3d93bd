"""Vectorised numpy kernels over the UTF-8 bytes of Arrow string columns.

Every kernel takes one *slice*: ``data`` (uint8), ``offsets`` (int64, n+1) and
``rows`` (the batch row of each piece).  ``slices`` cuts a batch so that no
slice holds more than ``limit`` bytes; a longer text comes in several pieces of
the same row, cut after white space where there is some, so memory is bounded
by ``limit`` and not by the longest text.  Callers add pieces up by row.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _odd(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit multipliers: powers of an odd constant."""
    out = np.empty(n, np.uint64)
    x, p = 1, (0x9E3779B97F4A7C15 ^ (2 * seed)) | 1
    for i in range(n):
        out[i] = x
        x = x * p & 0xFFFFFFFFFFFFFFFF
    return out


_POW = _odd(7, 4096)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives freed memory back to the system; a reused worker else keeps its largest size."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def mix64(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BYTE_HASH = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = pc.fill_null(col, b"")
    n = len(col)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(col: pa.Array, limit: int = SLICE_BYTES, whole: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(data, offsets, rows) pieces of a column, each of at most ``limit`` bytes.

    ``whole``: a text longer than the limit is a slice of its own, uncut.
    """
    data, off = column_bytes(col)
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, "right")) - 1
        j = max(j, i + 1) if whole else j
        if j > i:
            yield data[off[i] : off[j]], off[i : j + 1] - off[i], np.arange(i, j)
            i = j
            continue
        a, end = int(off[i]), int(off[i + 1])  # one text longer than the limit
        while a < end:
            b = min(a + limit, end)
            if b < end:
                gap = np.flatnonzero(_SPACE[data[b - 4096 : b]]) if limit > 4096 else []
                b = b - 4096 + int(gap[-1]) + 1 if len(gap) else b
            yield data[a:b], np.array([0, b - a]), np.array([i])
            a = b
        i += 1


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``mask`` within each piece."""
    if not len(mask):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(mask))]
    turn = np.empty(len(mask) + 1, bool)
    turn[0], turn[-1] = mask[0], mask[-1]
    np.not_equal(mask[1:], mask[:-1], out=turn[1:-1])
    start, end = turn.copy(), turn
    start[:-1] &= mask
    start[-1] = False
    end[1:] &= mask
    end[0] = False
    both = inner[mask[inner] & mask[inner - 1]]
    start[both] = True
    end[both] = True
    return np.flatnonzero(start), np.flatnonzero(end)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, piece) of each run of non-space bytes."""
    s, e = spans(~_SPACE[data], offsets)
    return s, e, np.searchsorted(offsets, s, "right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans ascend and don't overlap."""
    if not len(start):
        return np.empty(0, np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(first, size)
    src = data[at + np.repeat(start, size)]
    term = _BYTE_HASH[_LOWER[src] if lower else src] * _POW[at & 4095]
    if size.max() > 4096:  # so that blocks of 4096 bytes can't change places
        term *= (2 * (at >> 12) + 1).astype(np.uint64)
    return mix64(np.add.reduceat(term, first) + size.astype(np.uint64))


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one, same): the place of a key of each value, in order of value, and the number of each key's value."""
    order = np.argsort(key)
    k = key[order]
    new = np.r_[True, k[1:] != k[:-1]] if len(k) else np.empty(0, bool)
    same = np.empty(len(key), np.int64)
    same[order] = np.cumsum(new) - 1
    return order[new], same


def stable_order(key: np.ndarray) -> np.ndarray:
    """A stable order of integers; by 16 bits at a time, which is quicker, where they lie close together."""
    if not len(key):
        return np.empty(0, np.int64)
    low = key - key.min()
    most = int(low.max())
    if most < 1 << 16:
        return np.argsort(low.astype(np.uint16), kind="stable")
    if most < 1 << 32:
        order = np.argsort((low & 0xFFFF).astype(np.uint16), kind="stable")
        return order[np.argsort((low >> 16).astype(np.uint16)[order], kind="stable")]
    return np.argsort(key, kind="stable")


def distinct_words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one, same) of the spans that ``data`` is cut into at ``cuts``: a span of each content, and each span's.

    Found by hash, then compared by their bytes; contents of equal hash are told apart.
    """
    size = np.diff(np.r_[cuts, len(data)])
    place = np.arange(len(data)) - np.repeat(cuts, size)
    h = np.add.reduceat(_BYTE_HASH[data] * _POW[place & 4095], cuts) + size.astype(np.uint64) if len(cuts) else np.empty(0, np.uint64)
    one, same = distinct(h)
    like = one[same]
    if (size[like] == size).all() and (data[np.repeat(cuts[like], size) + place] == data).all():
        return one, same
    text, ends, seen = data.tobytes(), cuts + size, {}
    same = np.array([seen.setdefault(text[a:b], len(seen)) for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)])
    return np.unique(same, return_index=True)[1], same


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values in [bounds[i], bounds[i+1]); 0 where that is empty."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), np.result_type(values.dtype, np.float64) if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full], axis=0, dtype=out.dtype)
    return out


def majority(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The SimHash of each piece of hashes: bits that are set in over half of them (none: zero)."""
    counts = np.zeros((len(bounds) - 1, 64), np.int64)
    step = 1 << 16
    for k in range(0, len(h), step):  # so that the bits of few shingles are in memory
        part = np.unpackbits(h[k : k + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cut = np.clip(bounds, k, k + len(part)) - k
        full = np.flatnonzero(cut[1:] > cut[:-1])
        counts[full] += np.add.reduceat(part, cut[full], axis=0, dtype=np.int32)
    bits = (2 * counts > np.diff(bounds)[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
