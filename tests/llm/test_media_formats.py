"""Later end marks, nested archives, headers with comments, many false magic numbers, and the features."""

import io
import math
import struct
import time
import zipfile
import zlib

import numpy as np
import pytest

from knnloom.llm import media

from .test_operators import OBJECTS


def found(value, kind):
    return [(f.offset, f.length) for f in media.sniff(value) if f.kind == kind]


def test_pdf_ends_at_its_last_mark():
    first = b"%PDF-1.4\nbody\nstartxref\n9\n%%EOF\n"
    updated = first + b"5 0 obj more endobj\nstartxref\n40\n%%EOF"
    assert found(b"x" + updated + b"\ntrailing", "pdf") == [(1, len(updated))]
    assert found(first + b"no reference %%EOF", "pdf") == [(0, len(first) - 1)]
    assert found(first + updated, "pdf") == [(0, len(first) - 1), (len(first), len(updated))]
    assert found(b"%PDF-1.4 startxref nine %%EOF", "pdf") == []


def archive(names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in names.items():
            z.writestr(name, content)
        z.comment = b"a note"
    return out.getvalue()


def test_archives_in_archives():
    inner = archive({"a.txt": "one", "b.txt": "two"})
    outer = archive({"inner.zip": inner, "c.txt": "three"})
    value = b"some bytes" + outer + b"and more"
    got = found(value, "zip")
    assert (10, len(outer)) in got and (value.index(inner), len(inner)) in got and len(got) == 2


@pytest.mark.parametrize(("head", "size"), [(b"P5\n# a comment\n2 2\n255\n", 4), (b"P6\n2\t2 # another\n65535\n", 24), (b"P5\n2 2 1000\n", 8)])
def test_headers_of_pnm(head, size):
    kind = "ppm" if head[1:2] == b"6" else "pgm"
    assert found(b".." + head + b"\1" * size + b"rest", kind) == [(2, len(head) + size)]
    assert found(head + b"\1" * (size - 1), kind) == []


def test_fill_bytes_of_jpeg():
    value = b"\xff\xd8\xff\xff\xff\xe0" + struct.pack(">H", 4) + b"JF" + b"\xff\xda" + struct.pack(">H", 3) + b"x" + b"ab\xff\0cd\xff\xd3ef" + b"\xff\xff\xd9"
    assert found(value + b"more", "jpeg") == [(0, len(value))]


def test_magic_inside_gzip_data_is_none():
    raw = b"\x1f\x8b\x08" * 50 + b"BM"
    packed = zlib.compressobj(0, zlib.DEFLATED, 31)
    value = packed.compress(raw) + packed.flush()
    assert found(b"-" + value + b"--", "gzip") == [(1, len(value))]


@pytest.mark.parametrize("magic", [b"%PDF-", b"PK\x03\x04", b"P5\n", b"\xff\xd8\xff", b"GIF89a", b"RIFF", b"BM", b"\x1f\x8b\x08", b"%PDF-startxref 1%%EOF"])
def test_many_magic_numbers_take_linear_time(magic):
    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        media.sniff(magic * n)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.3


def test_features_of_samples():
    for text in (b"", b"short text", "naïve café ".encode() * 90, b"RIFF" * 150, OBJECTS["png"] * 3):
        payload = text + b"\xff" * (-len(text) % 576 if text else 576)
        stored = media.store_wav(payload)
        n = len(payload)
        mean = sum(payload) / n
        spread = math.sqrt(max(sum(x * x for x in payload) / n - mean**2, 0))
        crossings = sum((a > 127) != (b > 127) for a, b in zip(payload, payload[1:], strict=False))
        share = [payload.count(x) / n for x in set(payload)]
        kind, inner, *numbers = media.features(payload, media.sniff(stored)).split(";")
        assert kind == "wav" and int(numbers[2]) == crossings
        assert [float(numbers[k]) for k in (0, 1, 3)] == pytest.approx([mean, spread, -sum(p * math.log2(p) for p in share)], abs=1e-4)
        assert inner.count("png@") == (3 if text.startswith(b"\x89PNG") else 0)


CHAINS = {
    "gif": b"GIF89a" + b"!" * 7 + b"!a" + b"\x60" + b"a" * 30,  # valid UTF-8: each head's blocks go on over the next heads
    "jpeg": b"\xff\xd8\xff\xe0\x00\x02",
    "jpeg scan": b"\xff\xd8\xff\xda\x00\x02\xff\x00\xff\xd0",
    "png": b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\x0dIHDR" + b"\x00" * 13 + struct.pack(">I", zlib.crc32(b"IHDR" + b"\x00" * 13)),
    "riff": b"RIFF\x10\x27\x00\x00AVI LIST\x04\x00\x00\x00",  # each form is 10 000 bytes of the next forms' chunks
    "png of one chunk": b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x10\x00IHDR",
}


@pytest.mark.parametrize("name", CHAINS)
def test_chains_of_heads_take_linear_time(name):
    took = []
    for n in (4000, 16_000):
        value = CHAINS[name] * n
        began = time.process_time()
        media.sniff(value)
        took.append(time.process_time() - began)
    assert took[1] < 5 * took[0] + 0.3


def test_walks_equal_plain_ones():
    """Random structures against walks that start anew at each head."""

    def gif(b, at):
        def blocks(k):
            while k < len(b) and b[k]:
                k += 1 + b[k]
            return k + 1

        if at + 13 > len(b):
            return None
        k = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 128 else 0)
        while k < len(b):
            if b[k] == 0x3B:
                return k + 1 - at
            if b[k] == 0x21:
                k = blocks(k + 2)
            elif b[k] == 0x2C and k + 10 <= len(b):
                k = blocks(k + 11 + (3 << ((b[k + 9] & 7) + 1) if b[k + 9] & 128 else 0))
            else:
                return None
        return None

    def jpeg(b, at):
        k = at + 2
        while k + 4 <= len(b) and b[k] == 255:
            kind = b[k + 1]
            if kind == 255:
                k += 1
                continue
            if kind in (0xD8, 0xD9, 0):
                return None
            k += 2 + struct.unpack_from(">H", b, k + 2)[0]
            if kind == 0xDA:
                while k + 1 < len(b) and (b[k] != 255 or b[k + 1] in (0, 255) or 0xD0 <= b[k + 1] <= 0xD7):
                    k += 1
                if k + 1 >= len(b):
                    return None
                if b[k + 1] == 0xD9:
                    return k + 2 - at
        return None

    rng = np.random.default_rng(8)
    hits = 0
    for _ in range(3000):
        b = bytes(rng.choice([0, 1, 2, 3, 0x21, 0x2C, 0x3B, 255, 255, 0xD0, 0xD8, 0xD9, 0xDA, 0xE0], 120).astype(np.uint8))
        v = media.Value(b)
        for at in rng.permutation(100)[:40].tolist():
            for made, plain in ((media._gif, gif), (media._jpeg, jpeg)):
                got = made(v, at)
                assert got == plain(b, at)
                hits += got is not None
    assert hits > 100


def test_riff_chunks_equal_a_plain_walk():
    def plain(b, at, form, need):
        if at + 12 > len(b) or b[at + 8 : at + 12] != form:
            return None
        end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
        if end > len(b):
            return None
        seen, k = set(), at + 12
        while k + 8 <= end:
            seen.add(b[k : k + 4])
            n = struct.unpack_from("<I", b, k + 4)[0]
            k += 8 + n + (n & 1)
        return end - at if k in (end, end + 1) and (not need or seen & set(need)) else None

    rng = np.random.default_rng(3)
    heads = [b"RIFF%sWAVE", b"RIFF%sWEBP", b"RIFF%sAVI ", b"data%s", b"VP8X%s", b"LIST%s"]
    hits = 0
    for _ in range(400):
        b = b"".join(heads[i].replace(b"%s", struct.pack("<I", int(n))) for i, n in zip(rng.integers(0, 6, 60), rng.integers(0, 60, 60) * rng.integers(0, 2, 60), strict=True)) + bytes(7)
        v = media.Value(b)
        for at in [i for i in range(len(b)) if b[i : i + 4] == b"RIFF"]:
            for form, bit, need in ((b"WAVE", 1, (b"data",)), (b"WEBP", 2, (b"VP8 ", b"VP8L", b"VP8X")), (b"AVI ", 0, ())):
                got = media._riff(v, at, form, bit)
                assert got == plain(b, at, form, need)
                hits += got is not None
    assert hits > 100
