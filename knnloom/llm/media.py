"""Media columns by signature sniffing.

One Aho-Corasick automaton finds the magic bytes of all known formats, and their
end marks, in one walk over a value; a validator of each format then checks
structure and lengths from there, in the value itself.  What is confirmed at the start is the value's real type, which
corrects a declared one; what is confirmed further on is embedded and can be
carved out.  Magic bytes without a valid structure count for nothing.

``store_wav`` is a lossless container for bytes: a mono WAV file of 8-bit
samples.  Its validator gives back the extent of the samples.

Defined cases.  A null or empty value has type ``unknown`` and no objects.
Truncated objects aren't confirmed.  Objects inside a confirmed object are
listed as well, those that seem to lie within gzip data excepted.  Very long values are walked whole.  Equal values give equal
results.  Other columns are neither read nor changed; input columns with the
outputs' names are replaced.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect, bisect_left
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 576
#: Sample rate of stored payloads, in Hz; it doesn't change the samples.
RATE = 8000


@dataclass(frozen=True)
class Found:
    kind: str
    offset: int
    length: int


class Value:
    """The bytes of a value and where its magic bytes and end marks are, found in one walk."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self.view = raw, memoryview(raw)
        self.at: dict[bytes, list[int]] = {}
        self.streams: dict[int, int | None] = {}  # ends of deflate streams by their start
        self.walks: dict[str, dict[int, int | None]] = {}
        self.chunks: dict[int, tuple[int, int, int, int, int]] = {}
        for end, magic in automaton().iter(raw.decode("latin-1")):
            self.at.setdefault(magic, []).append(end + 1 - len(magic))

    def walked(self, kind: str, k: int, step: Callable[[int], tuple[int | None, bool]]) -> int | None:
        """Where the walk from a place ends, by steps to (next place, False) or (end or None, True).

        Each place is walked on from once, whichever head comes to it.
        """
        known, seen = self.walks.setdefault(kind, {}), []
        while k not in known:
            seen.append(k)
            then, over = step(k)
            if over:
                known[k] = then
                break
            k = then
        end = known[k]
        known.update(dict.fromkeys(seen, end))
        return end

    def _chain(self, k: int) -> None:
        """Notes the RIFF chunks from a place on: next, a far jump, how many follow, kind, and kinds up to the jump."""
        b, known, path = self.raw, self.chunks, []
        while k not in known and k + 8 <= len(b):
            path.append(k)
            n = int.from_bytes(b[k + 4 : k + 8], "little")
            k += 8 + n + (n & 1)
        known.setdefault(k, (k, k, 0, 0, 0))
        for place in reversed(path):
            _, jump, after, _, kinds = known[k]
            _, far, there, _, more = known[jump]
            kind = _CHUNKS.get(b[place : place + 4], 0)
            # jumps of equal length are joined, so that a walk takes the logarithm of its chunks
            known[place] = (k, far, after + 1, kind, kind | kinds | more) if after - there == there - known[far][2] else (k, k, after + 1, kind, kind)
            k = place

    def chunks_before(self, k: int, end: int) -> tuple[int, int]:
        """Where the RIFF chunks from a place on, as far as they begin before the end, lead to; and their kinds."""
        seen = 0
        if k + 8 <= end:
            self._chain(k)
        while k + 8 <= end:
            after, jump, _, kind, kinds = self.chunks[k]
            k, seen = (jump, seen | kinds) if jump + 8 <= end and jump > k else (after, seen | kind)
        return k, seen

    @cached_property
    def marks(self) -> list[int]:
        """Places of JPEG markers that end entropy-coded data: no stuffing, fill or restart."""
        b = np.frombuffer(self.raw, np.uint8)
        at = np.flatnonzero(b[:-1] == 255)
        after = b[at + 1]
        return at[(after != 0) & (after != 255) & ((after < 0xD0) | (after > 0xD7))].tolist()

    @cached_property
    def zeros(self) -> np.ndarray:
        """Places of the zero bytes."""
        return np.flatnonzero(np.frombuffer(self.raw, np.uint8) == 0)

    @cached_property
    def archives(self) -> dict[int, int]:
        """Start and end of each ZIP archive whose end record fits the directory before it."""
        out, b = {}, self.raw
        for end in self.at.get(ZIP_END, []):
            if end + 22 > len(b):
                continue
            n, start, note = struct.unpack_from("<4xIIH", b, end + 8)
            at = end - n - start
            if at >= 0 and n and b[at + start : at + start + 4] == b"PK\x01\x02" and end + 22 + note <= len(b):
                out[at] = end + 22 + note
        return out

    @cached_property
    def documents(self) -> dict[int, int]:
        """Start and end of each PDF: its last end mark that a cross-reference goes before."""
        out, heads = {}, self.at.get(PDF, [])
        starts = self.at.get(PDF_REFERENCE, [])
        for end in self.at.get(PDF_END, []):
            head, ref = bisect(heads, end) - 1, bisect(starts, end) - 1
            if head >= 0 and ref >= 0 and starts[ref] > heads[head] and self.raw[starts[ref] + len(PDF_REFERENCE) : end].strip().isdigit():
                out[heads[head]] = end + len(PDF_END)
        return out


#: Kinds of RIFF chunks that a form can need.
_CHUNKS = {b"data": 1, b"VP8 ": 2, b"VP8L": 2, b"VP8X": 2}


def _riff(v: Value, at: int, form: bytes, need: int) -> int | None:
    b = v.raw
    if at + 12 > len(b) or b[at + 8 : at + 12] != form:
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return None
    k, seen = v.chunks_before(at + 12, end)
    return end - at if k in (end, end + 1) and (not need or seen & need) else None


def _png(v: Value, at: int) -> int | None:
    b = v.raw

    def chunk(k: int) -> tuple[int | None, bool]:
        if k + 12 > len(b):
            return None, True
        n, kind = struct.unpack_from(">I4s", b, k)
        if k + 12 + n > len(b) or zlib.crc32(v.view[k + 4 : k + 8 + n]) != struct.unpack_from(">I", b, k + 8 + n)[0]:
            return None, True
        return k + 12 + n, kind == b"IEND"

    if b[at + 8 : at + 16] != b"\0\0\0\x0dIHDR":
        return None
    end = v.walked("png", at + 8, chunk)
    return None if end is None else end - at


def _gif(v: Value, at: int) -> int | None:
    b = v.raw

    def block(k: int) -> tuple[int | None, bool]:
        return (k + 1, True) if k >= len(b) or not b[k] else (k + 1 + b[k], False)

    def part(k: int) -> tuple[int | None, bool]:
        if k < len(b) and b[k] == 0x3B:
            return k + 1, True
        if k < len(b) and b[k] == 0x21:
            return v.walked("gif blocks", k + 2, block), False
        if k + 10 <= len(b) and b[k] == 0x2C:
            f = b[k + 9]
            return v.walked("gif blocks", k + 11 + (3 << ((f & 7) + 1) if f & 128 else 0), block), False
        return None, True

    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    end = v.walked("gif", at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0), part)
    return None if end is None else end - at


def _jpeg(v: Value, at: int) -> int | None:
    b = v.raw

    def segment(k: int) -> tuple[int | None, bool]:
        if k + 4 > len(b) or b[k] != 255:
            return None, True
        kind = b[k + 1]
        if kind == 255:  # a fill byte
            return k + 1, False
        if kind in (0xD8, 0xD9, 0):
            return None, True
        k += 2 + struct.unpack_from(">H", b, k + 2)[0]
        if kind != 0xDA:
            return k, False
        i = bisect_left(v.marks, k)  # entropy-coded data up to a marker that isn't stuffing or a restart
        if i == len(v.marks):
            return None, True
        return (v.marks[i] + 2, True) if b[v.marks[i] + 1] == 0xD9 else (v.marks[i], False)

    end = v.walked("jpeg", at + 2, segment)
    return None if end is None else end - at


def _bmp(v: Value, at: int) -> int | None:
    b = v.raw
    if at + 26 > len(b):
        return None
    size, _, start, head = struct.unpack_from("<IIII", b, at + 2)
    return size if head in (12, 40, 52, 56, 108, 124) and 14 + head <= start <= size and at + size <= len(b) else None


def _gzip(v: Value, at: int) -> int | None:
    b, k = v.raw, at + 10
    if k > len(b) or b[at + 3] & 0xE0:
        return None
    flags = b[at + 3]
    if flags & 4:  # extra field
        k += 2 + (struct.unpack_from("<H", b, k)[0] if k + 2 <= len(b) else 0)
    for flag in (8, 16):  # name and comment, up to a zero byte each
        if flags & flag:
            i = int(np.searchsorted(v.zeros, k))
            if i == len(v.zeros):
                return None
            k = int(v.zeros[i]) + 1
    k += 2 if flags & 2 else 0
    if k not in v.streams:
        v.streams[k] = _inflated(v, k)
    end = v.streams[k]
    return end - at if end is not None else None


def _inflated(v: Value, k: int) -> int | None:
    """The end of a deflate stream and its checksum and length."""
    d, crc, size = zlib.decompressobj(-15), 0, 0
    try:
        while not d.eof and (k < len(v.raw) or d.unconsumed_tail):
            part = d.unconsumed_tail or v.view[k : k + CHUNK]
            k += 0 if d.unconsumed_tail else len(part)
            out = d.decompress(part, 16 * CHUNK)
            crc, size = zlib.crc32(out, crc), size + len(out)
    except zlib.error:
        return None
    k -= len(d.unused_data) + len(d.unconsumed_tail)
    return k + 8 if d.eof and v.raw[k : k + 8] == struct.pack("<II", crc, size & 0xFFFFFFFF) else None


def _pdf(v: Value, at: int) -> int | None:
    return v.documents[at] - at if at in v.documents else None


def _zip(v: Value, at: int) -> int | None:
    return v.archives[at] - at if at in v.archives else None


#: Fixed value: magic, width, height and largest sample, with white space and comments between them.
_NETPBM = re.compile(rb"P([56])" + rb"(?:\s|#[^\n]*+\n)++(\d++)" * 3 + rb"\s")


def _netpbm(v: Value, at: int) -> int | None:
    m = _NETPBM.match(v.raw, at)
    if not m or any(len(x) > 9 for x in m.groups()):
        return None
    wide, high, most = (int(x) for x in m.groups()[1:])
    end = m.end() + wide * high * (3 if m[1] == b"6" else 1) * (2 if most > 255 else 1)
    return end - at if 0 < most < 65536 and m.end() < end <= len(v.raw) else None


#: Bytes of a stream that are decompressed at a time.
CHUNK = 1 << 16
PDF, PDF_REFERENCE, PDF_END, ZIP_END = b"%PDF-", b"startxref", b"%%EOF", b"PK\x05\x06"
#: The magic bytes of each format.
MAGIC: dict[bytes, list[tuple[str, Callable[[Value, int], int | None]]]] = {
    b"RIFF": [("wav", lambda v, at: _riff(v, at, b"WAVE", 1)), ("webp", lambda v, at: _riff(v, at, b"WEBP", 2)), ("avi", lambda v, at: _riff(v, at, b"AVI ", 0))],
    b"\x89PNG\r\n\x1a\n": [("png", _png)],
    b"GIF87a": [("gif", _gif)],
    b"GIF89a": [("gif", _gif)],
    b"\xff\xd8\xff": [("jpeg", _jpeg)],
    b"BM": [("bmp", _bmp)],
    b"\x1f\x8b\x08": [("gzip", _gzip)],
    PDF: [("pdf", _pdf)],
    b"PK\x03\x04": [("zip", _zip)],
    b"P5\n": [("pgm", _netpbm)],
    b"P6\n": [("ppm", _netpbm)],
}
_automaton = None


def automaton():
    """The automaton of all magic bytes and end marks, built once in a process."""
    global _automaton
    if _automaton is None:
        made = ahocorasick.Automaton()
        for magic in (*MAGIC, PDF_REFERENCE, PDF_END, ZIP_END):
            made.add_word(magic.decode("latin-1"), magic)
        made.make_automaton()
        _automaton = made
    return _automaton


def sniff(value: bytes | None) -> list[Found]:
    """All confirmed objects of a value, by offset; what looks like one inside compressed data isn't."""
    if not value:
        return []
    found, v, packed = [], Value(value), 0
    for at, magic in sorted((at, magic) for magic, places in v.at.items() if magic in MAGIC for at in places):
        for kind, check in MAGIC[magic] if at >= packed else ():
            if (n := check(v, at)) is not None:
                found.append(Found(kind, at, n))
                packed = at + n if kind == "gzip" else packed
    return sorted(found, key=lambda x: (x.offset, x.kind))


def with_media(table: DataFrame, content: str, declared: str | None = None) -> DataFrame:
    """The table with ``media_type`` (confirmed, else unknown), ``media_length``,
    ``corrected`` (the declared type was another) and ``embedded`` objects with their bytes."""

    def look(col: pa.Array) -> pa.Array:
        kinds, lengths, inner = [], [], []
        for value in col.to_pylist():
            found = sniff(value)
            top = next((x for x in found if x.offset == 0), None)
            kinds.append(top.kind if top else "unknown")
            lengths.append(top.length if top else None)
            inner.append([{"kind": x.kind, "offset": x.offset, "length": x.length, "content": value[x.offset : x.offset + x.length]} for x in found if x is not top])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("content", pa.binary())]))
        return pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.array(lengths, pa.int64()), pa.array(inner, kind)], ["media_type", "media_length", "embedded"])

    udf = F.arrow_udf(look, "media_type string, media_length bigint, embedded array<struct<kind string, offset bigint, length bigint, content binary>>")
    got = table.withColumn("__media", udf(F.col(content).cast("binary")))
    said = F.lower(F.col(declared)) if declared else F.lit(None).cast("string")
    cols = {c: F.col(f"__media.{c}") for c in ("media_type", "media_length", "embedded")}
    return got.withColumns(cols | {"corrected": F.coalesce(said != F.col("__media.media_type"), F.lit(False))}).drop("__media")


def store_wav(payload: bytes) -> bytes:
    """A mono 8-bit WAV file whose samples are the payload."""
    pad = b"\0" * (len(payload) & 1)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + pad


def read_wav(stored: bytes, found: Found) -> bytes:
    """The samples of a confirmed WAV object."""
    k, end = found.offset + 12, found.offset + found.length
    while k + 8 <= end:
        kind, n = struct.unpack_from("<4sI", stored, k)
        if kind == b"data":
            return stored[k + 8 : k + 8 + n]
        k += 8 + n + (n & 1)
    raise ValueError("no samples")


def features(payload: bytes, found: list[Found]) -> str:
    """Type and objects found, then level, spread, crossings and entropy of the samples."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / max(len(x), 1)
    mean = float(share @ np.arange(256))
    spread = float(np.sqrt(max(share @ np.arange(256.0) ** 2 - mean**2, 0)))
    high = x > 127
    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
    inner = ",".join(f"{f.kind}@{f.offset}+{f.length}" for f in found if f.offset)
    return f"{found[0].kind if found else 'unknown'};{inner};{mean:.4f};{spread:.4f};{int((high[1:] != high[:-1]).sum())};{entropy:.4f}"


def stored_features(text: pa.Array) -> pa.Array:
    """Each text stored, sniffed, read back and described; nulls as empty."""
    rows = []
    for value in text.cast(pa.binary()).to_pylist():
        raw = value or b""
        payload = raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)
        stored = store_wav(payload)
        found = sniff(stored)
        back = read_wav(stored, next(f for f in found if f.kind == "wav" and f.offset == 0))
        rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), features(back, found)))
    cols = list(zip(*rows, strict=True)) or [[]] * 7
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], STORED)


STORED = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def op9_media(spark, sf_dir: str) -> DataFrame:
    """Every document as a stored media value; see the module for the defined cases."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    udf = F.arrow_udf(stored_features, "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
    return docs.select("doc_id", udf("text").alias("m")).select("doc_id", *(F.col(f"m.{c}").alias(c) for c in STORED))
