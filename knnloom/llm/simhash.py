"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments of at most 23 bits.  The
[23,12,7] Golay code is perfect: every segment value decodes to one codeword.
The codes of a value are the codewords of all values within one bit of it; two
values at most two bits apart have a value within one bit of both, so they
share a code.  Of four errors over three segments, either one segment has none
and another two at most, or two segments have one each and the third two at
most.  So the keys of a fingerprint are a whole segment with a code of another,
and halves of two segments (a single error leaves a half as it is) with a code of
the third.  They find every link of four bits or fewer, and each key fixes 32
bits or more, so chance meetings stay rare up to 10^9 fingerprints; candidates
that meet in a key are verified by their distance.

Equal fingerprints are joined first.  Keys are sorted on the cluster and read
as a stream: within a key, links are found by shifted comparison or, for more
than SMALL members, reduced to a star for each local component, so copies are
never expanded into all pairs.  A key with more than BLOCK members is split
into blocks that are compared in pairs by other tasks.

Defined cases.  Null text: as empty.  A text without words has fingerprint zero
and is linked like any other.  Texts with fewer words than a shingle are one
shingle.  Repeated rows share their component; ids may repeat.  A component
whose ids are all null has a null id.  Very long texts are read whole.  An
empty table gives an empty result.  Other columns are neither read nor changed.
"""

from __future__ import annotations

import itertools
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .components import components
from .resemblance import resembling
from .session import pinned

WORDS = 4
SEED = 42
#: Differing bits of a link, and of candidates whose sets of shingles are compared.
LINK_BITS, REACH = 4, 16
SEGMENTS = (22, 21, 21)
#: Fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the code.
GENERATOR = 0xC75
SMALL, BLOCK = 16, 1024
#: Keys of a fingerprint, about, and keys whose links make one file.
KEYS, FILE_KEYS = 96, 1_000_000


def fingerprints(col: pa.Array, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The 64-bit SimHash of each text as uint64."""
    out = np.zeros(len(col), np.uint64)
    digest = xxhash.xxh64_intdigest
    for data, off, rows in tb.slices(col, whole=True):
        ws, we, wp = tb.words(data, off)
        if not len(ws):
            continue
        size = we - ws
        place = np.cumsum(size + 1) - size - 1  # of each word in the text of words and single spaces
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        joined = np.full(int(place[-1] + size[-1]), 32, np.uint8)
        joined[at + np.repeat(place, size)] = tb._LOWER[data[at + np.repeat(ws, size)]]
        text = joined.tobytes()
        n = np.bincount(wp, minlength=len(rows))
        first = np.cumsum(n) - n
        grams = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
        bounds = np.r_[0, np.cumsum(grams)]
        a = np.arange(bounds[-1]) - np.repeat(bounds[:-1], grams) + np.repeat(first, grams)
        b = a + np.repeat(np.minimum(n, words), grams) - 1
        start, end = place[a], place[b] + size[b]
        h = np.fromiter((digest(text[i:j], seed) for i, j in zip(start.tolist(), end.tolist(), strict=True)), np.uint64, len(start))
        out[rows] = tb.majority(h, bounds)
    tb.release()
    return out


class Golay:
    """Decoding of the perfect [23,12,7] code by syndrome tables."""

    def __init__(self) -> None:
        syndrome = np.zeros(23, np.int64)
        for i in range(23):
            v = 1 << i
            for k in range(22, 10, -1):
                if v >> k & 1:
                    v ^= GENERATOR << (k - 11)
            syndrome[i] = v
        spread = lambda bits, base: np.array([np.bitwise_xor.reduce([0, *(syndrome[base + i] for i in range(bits) if v >> i & 1)]) for v in range(1 << bits)])
        self.low, self.high = spread(12, 0), spread(11, 12)
        self.error = np.zeros(2048, np.int64)
        for w in range(4):
            for at in itertools.combinations(range(23), w):
                self.error[np.bitwise_xor.reduce([0, *syndrome[list(at)]])] = sum(1 << i for i in at)

    def index(self, v: np.ndarray) -> np.ndarray:
        """The message bits (12) of the codeword nearest to each value."""
        return (v ^ self.error[self.low[v & 4095] ^ self.high[v >> 12]]) >> 11

    def keys(self, v: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """[n, bits+1] sorted codeword indices of the values within one bit, and which are new."""
        flips = np.r_[0, 1 << np.arange(bits)]
        got = np.sort(self.index(v[:, None] ^ flips), 1)
        return got, np.c_[np.ones(len(v), bool), got[:, 1:] != got[:, :-1]]


def key_rows(batches):
    """(key, fp) rows of fingerprints."""
    code = Golay()
    for batch in batches:
        whole = batch.column(0).to_numpy(zero_copy_only=False)
        for k in range(0, len(whole), 4096):
            fp = whole[k : k + 4096]
            u, seg, raw = fp.astype(np.int64).view(np.uint64), [], []
            for i, bits in enumerate(SEGMENTS):
                v = ((u >> np.uint64(sum(SEGMENTS[:i]))) & np.uint64((1 << bits) - 1)).astype(np.int64)
                got, new = code.keys(v, bits)
                most = int(new.sum(1).max())
                order = np.argsort(~new, 1, kind="stable")[:, :most]
                seg.append((np.take_along_axis(got, order, 1), np.take_along_axis(new, order, 1)))
                raw.append(v)
            whole_of = [v[:, None] for v in raw]
            halves = [np.stack([v & 2047, v >> 11 | 1 << 11], 1) for v in raw]  # 12 bits: which half, and its 11 bits at most
            for third, (codes, new) in enumerate(seg):
                i, j = (x for x in range(3) if x != third)
                pairs = (halves[i][:, :, None] << 12 | halves[j][:, None, :]).reshape(len(fp), 4)
                for p, known in ((0, whole_of[i]), (1, whole_of[j]), (2, pairs)):
                    key = ((known[:, :, None] << 12) | codes[:, None, :]) << 4 | (3 * third + p)
                    use = np.broadcast_to(new[:, None, :], key.shape)
                    owner = np.broadcast_to(np.arange(len(fp))[:, None, None], key.shape)[use]
                    yield pa.RecordBatch.from_arrays([pa.array(key[use]), pa.array(fp[owner])], ["key", "fp"])


def _near(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= bits


def _stars(fp: np.ndarray, side: np.ndarray | None = None, bits: int = LINK_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of the components of near members; with sides only links across them count."""
    near = _near(fp[:, None].copy(), fp[None, :].copy(), bits)
    if side is not None:
        near &= side[:, None] != side[None, :]
    np.fill_diagonal(near, True)
    label = np.arange(len(fp))
    while True:
        least = np.where(near, label[None, :], len(fp)).min(1)
        least = np.minimum(least, least[least])
        if (least == label).all():
            break
        label = least
    rest = np.flatnonzero(label != np.arange(len(fp)))
    return fp[rest], fp[label[rest]]


def _out(u, v, key=None, block=None):
    n = len(u)
    none = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()) if v is not None else none, pa.array(key, pa.int64()) if key is not None else none, pa.array(block, pa.int64()) if block is not None else none], ["u", "v", "key", "block"])


LINKS = "u bigint, v bigint, key bigint, block bigint"


def link_rows(batches, bits: int = LINK_BITS):
    """Links within the keys of a stream that is sorted by key.

    Rows (u, v) are links.  Members of a key with more than BLOCK rows also come
    as (u, null, key, block), for comparison across blocks.
    """
    held_key, held_fp, blocks = np.empty(0, np.int64), np.empty(0, np.int64), {}

    def work(key, fp, last):
        cuts = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)] if len(key) else np.zeros(1, np.int64)
        size, start = np.diff(cuts), cuts[:-1]
        small = np.repeat(size <= SMALL, size)
        for d in range(1, min(SMALL, int(size.max(initial=1)))):
            i = np.flatnonzero(small[:-d] & (key[d:] == key[:-d]))
            if not len(i):
                break
            i = i[_near(fp[i], fp[i + d], bits)]
            if len(i):
                yield _out(fp[i], fp[i + d])
        for g in np.flatnonzero((size > SMALL) | ((start + size == len(key)) & (not last)) | np.isin(key[start], list(blocks))):
            k, a, b = int(key[start[g]]), int(start[g]), int(start[g] + size[g])
            if size[g] > SMALL:
                for lo in range(a, b, BLOCK):
                    u, v = _stars(fp[lo : min(lo + BLOCK, b)], bits=bits)
                    if len(u):
                        yield _out(u, v)
            if size[g] > BLOCK or k in blocks:
                first = blocks.get(k, 0)
                yield _out(fp[a:b], None, np.full(b - a, k), first + np.arange(b - a) // BLOCK)
                blocks[k] = first + -(-(b - a) // BLOCK)
        for k in [k for k in blocks if not len(key) or k != key[-1]]:
            del blocks[k]

    for batch in batches:
        key = np.r_[held_key, batch.column(0).to_numpy(zero_copy_only=False)]
        fp = np.r_[held_fp, batch.column(1).to_numpy(zero_copy_only=False)]
        if not len(key):
            continue
        end = int(np.searchsorted(key, key[-1], "left"))  # the last key may go on
        if end == 0 and len(key) >= 4 * BLOCK:  # all of one key: hand it on in whole blocks
            end = len(key) // BLOCK * BLOCK
            yield from work(key[:end], fp[:end], False)
        elif end:
            yield from work(key[:end], fp[:end], True)
        held_key, held_fp = key[end:], fp[end:]
    if len(held_key):
        yield from work(held_key, held_fp, True)


def cross_rows(batches, bits: int = LINK_BITS):
    """Links across the two sides of block pairs, from (key, lo, hi, side, fp) sorted by the first three."""
    held = None

    def work(cols):
        pair = np.stack(cols[:3], 1)
        cuts = np.r_[0, np.flatnonzero((pair[1:] != pair[:-1]).any(1)) + 1, len(pair)]
        for a, b in itertools.pairwise(cuts):
            u, v = _stars(cols[4][a:b].copy(), cols[3][a:b], bits)
            if len(u):
                yield _out(u, v)

    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        cols = [np.r_[h, c] for h, c in zip(held, cols, strict=True)] if held else cols
        if not len(cols[0]):
            continue
        same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
        end = int(np.argmax(same))
        if end:
            yield from work([c[:end] for c in cols])
        held = [c[end:] for c in cols]
    if held:
        yield from work(held)


def links(distinct: DataFrame, bits: int = LINK_BITS) -> tuple[DataFrame, int]:
    """Edges (u, v) that connect distinct fingerprints (fp) as links of so many bits do that meet in a key; those of LINK_BITS all do.

    Also about how many there are.
    """
    keys = distinct.select("fp").mapInArrow(key_rows, "key bigint, fp bigint")
    files = max(1, -(-distinct.count() * KEYS // FILE_KEYS))
    found = pinned(keys.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(partial(link_rows, bits=bits), LINKS).coalesce(files), "none")
    members = found.where("v is null")
    blocks = members.groupBy("key").agg((F.max("block") + 1).alias("n"))
    wide = members.join(blocks, "key").select("key", F.col("u").alias("fp"), "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("other")).where("block != other")
    pairs = wide.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "fp")
    across = pairs.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(partial(cross_rows, bits=bits), LINKS)
    return found.where("v is not null").select("u", "v").unionByName(across.select("u", "v")), found.count()


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp", words: int = WORDS) -> DataFrame:
    udf = F.arrow_udf(lambda col: pa.array(fingerprints(col, words).view(np.int64)), "bigint")
    return docs.withColumn(out, udf(F.col(text)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, least: float | None = None) -> DataFrame:
    """(id, fp, component_id) of each row: the smallest id that links of LINK_BITS bits reach.

    With ``least``, links are similarities of the sets of shingles of that much or
    more instead, and there is no fp.  Candidates are SimHashes of these sets that meet in
    a Golay key and differ in REACH bits at most.  At a similarity of 0.8 ten of 64 bits
    differ, so the keys find a part; ``resemblance`` adds what they miss, and verifies all.
    """
    if least is not None:
        return resembling(docs, id_col, text, words, least, lambda prints: links(prints, REACH)[0])
    prints = pinned(with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), words=words).select("id", "fp"), "none")
    distinct = prints.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(*links(distinct)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = pinned(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "none")  # so that a large root's rows can be split at the join
    of_print = rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("id", "fp", "component_id")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; see the module for the defined cases."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
