"""Removal of byte strings that repeat across documents, by suffix arrays.

Every MATCH-byte window of a text has an anchor: the least hash among the
ANCHOR-byte strings inside it.  Equal windows have equal anchors, so shards by
anchor hold all occurrences of their windows, and neighbouring windows with one
anchor travel as one snippet.

1. Anchors of all documents are compared, packed: a 64-bit hash chooses a part,
   of about PART_BYTES of text, and 40 bits of it are compared there, so how many
   meet by chance doesn't grow with the corpus.  An anchor
   that occurs once can't repeat.  Within a pack of texts repeated hashes travel
   once, so a frequent passage costs one entry a pack.
2. Snippets of the anchors that remain go to their shards, equal ones of a slice
   once, with the list of their places.
3. In a shard the distinct snippets are sorted as suffixes by external induced
   sorting (``suffixes``); windows between common prefixes of MATCH bytes are
   equal, and the smallest id among them is theirs.
4. Windows with a smaller id elsewhere are sent back to their documents and
   united to spans.

The anchors only leave out windows that are alone; what repeats is decided by
the suffix order.  Both joins with the texts need the same shuffle of them,
which Spark reuses.

Defined cases.  A null text is empty.  Texts shorter than a match keep all.
Rows with equal ids (or both null) don't remove from each other; a null id comes
after all others.  Repeated rows are told apart by file and row (input that isn't
read from files is pinned first).  Very long texts are read
whole.  An empty table gives an empty result.  Other columns are kept; input
columns with the names of the outputs are replaced.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .session import placed
from .suffixes import _PAD, MEMORY, repeat_chunks, room

MATCH, ANCHOR = 50, 16
LAST_ID = (1 << 63) - 1
#: Bytes of text for each part of the anchor hashes and for each shard of snippets, about.
PART_BYTES, SHARD_BYTES = 8 << 20, 4 << 20
#: Bytes of text whose anchors, or whose snippets, are packed together; they bound a worker's memory.
PACK_BYTES, SLICE_BYTES = 8 << 20, 2 << 20
#: Tasks of a step, at most; each goes through its parts or shards one after another.
TASKS = 50_000
#: Snippets, or places of them, that are looked at together in a shard.
SNIPPETS_AT_ONCE = 1 << 16
#: Windows whose anchors are found at a time.
BLOCK = 1 << 15
_PLACE = np.uint64((1 << 24) - 1)
_GROUP = 10  # documents with equal place >> _GROUP share packed rows
_SENT = 0xFFFF  # ordinal of an entry that wants no answer
MEMBER = np.dtype([("place", "<i8"), ("id", "<i8"), ("start", "<i4")])


def _least(data: np.ndarray, first: int) -> np.ndarray:
    """For each window of MATCH bytes the least hash in it (40 bits) and the place of that (24 bits)."""
    h, size = tb._BYTE_HASH[data], 1
    while size < ANCHOR:
        low = h[:-size] * tb._POW[2 * size + 1]
        low += h[size:]
        h, size = low, 2 * size
    h = tb.mix64(h)
    h &= ~_PLACE
    h |= np.arange(first, first + len(h), dtype=np.uint64) & _PLACE
    wide, size = MATCH - ANCHOR + 1, 1
    while 2 * size <= wide:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: -(wide - size)], h[wide - size :]) if wide > size else h


def _keys(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ANCHOR bytes at each place."""
    words = np.ascontiguousarray(data[at[:, None] + np.arange(ANCHOR)]).view("<u8")
    return tb.mix64(tb.mix64(words[:, 0]) * np.uint64(0x9E3779B97F4A7C15) + words[:, 1])


def snippets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, piece) of each run of windows with one anchor."""
    n = len(data)
    if n < MATCH:
        return (np.empty(0, np.uint64),) + (np.empty(0, np.int64),) * 3
    h = np.empty(n - MATCH + 1, np.uint64)
    for a in range(0, len(h), BLOCK):  # so much at a time that it stays in the processor's cache
        h[a : a + BLOCK] = _least(data[a : a + BLOCK + MATCH - 1], a)
    valid = np.zeros(len(h) + 1, np.int8)
    long = np.flatnonzero(np.diff(off) >= MATCH)
    np.add.at(valid, off[long], 1)
    np.add.at(valid, np.minimum(off[long + 1] - MATCH + 1, len(h)), -1)
    valid = np.cumsum(valid)[:-1] > 0
    first = valid.copy()
    first[1:] &= (h[1:] != h[:-1]) | ~valid[:-1]
    first[off[long]] = True
    a = np.flatnonzero(first)
    piece = np.searchsorted(off, a, "right") - 1
    last = np.minimum(np.r_[a[1:], len(h)] - 1, off[piece + 1] - MATCH)
    at = a + ((h[a].astype(np.int64) - a) & int(_PLACE))  # places are noted by their last 24 bits
    return _keys(data, at), a, last, piece


def _runs_in_doc(piece: np.ndarray, n: int) -> np.ndarray:
    """First run of each piece."""
    return np.searchsorted(piece, np.arange(n + 1))


def _grouped(key: np.ndarray, stable: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, values) of equal keys."""
    order = tb.stable_order(key) if stable else np.argsort(key)
    k = key[order]
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
    return order, start, k[start]


def _blobs(values: np.ndarray, start: np.ndarray) -> pa.Array:
    """The values of each group as bytes."""
    at = np.r_[start, len(values)] * values.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())


def _squeezed(values: np.ndarray, start: np.ndarray) -> pa.Array:
    """The values of each group as compressed bytes."""
    ends = np.r_[start[1:], len(values)]
    return pa.array([pa.compress(values[a:b].tobytes(), "zstd", asbytes=True) for a, b in zip(start.tolist(), ends.tolist(), strict=True)], pa.binary())


def _plain(blobs: list[bytes], sizes: list[int]) -> bytes:
    return b"".join(pa.decompress(b, n, "zstd", asbytes=True) for b, n in zip(blobs, sizes, strict=True))


PACKED = "part int, answered boolean, doc_group bigint, low binary, high binary, ordinal binary, run binary"


def anchor_rows(parts: int):
    """Packs the anchors of (place, text): by part those to be compared, and those known to repeat."""

    def pack(anchor, ordinal, run, group, part, known):
        one, number = tb.distinct(group)
        groups = max(len(one), 1)
        order, start, value = _grouped(part.astype(np.int64) * groups + number)
        cols = [(anchor[order] & np.uint64(0xFFFFFFFF)).astype("<u4"), (anchor[order] >> np.uint64(32)).astype("u1"), ordinal[order].astype("<u2"), run[order].astype("<u4")]
        return pa.RecordBatch.from_arrays(
            [pa.array((value // groups).astype(np.int32)), pa.array(np.full(len(start), known)), pa.array(group[one][value % groups]), *(_blobs(c, start) for c in cols[:2]), *(_squeezed(c, start) for c in cols[2:])],
            ["part", "answered", "doc_group", "low", "high", "ordinal", "run"],
        )

    part_of = lambda a: (tb.mix64(a) % np.uint64(parts)).astype(np.int64)

    def packed(got):
        anchor, where, number = (np.concatenate(c) for c in zip(*got, strict=True))
        if not len(anchor):
            return
        order, start, value = _grouped(anchor, stable=False)
        count = np.diff(np.r_[start, len(anchor)])
        group, ordinal = where >> _GROUP, where & ((1 << _GROUP) - 1)
        again = np.zeros(len(anchor), bool)
        again[order] = np.repeat(count > 1, count)
        one, shared = ~again, value[count > 1]
        yield pack(
            np.r_[anchor[one], shared], np.r_[ordinal[one], np.full(len(shared), _SENT)], np.r_[number[one], np.zeros(len(shared), np.int64)],
            np.r_[group[one], np.full(len(shared), group[0])], np.r_[part_of(anchor[one]), part_of(shared)], False,
        )
        if again.any():
            yield pack(anchor[again], ordinal[again], number[again], group[again], part_of(group[again].astype(np.uint64)), True)

    def run(batches):
        for batch in batches:
            place = batch.column(0).to_numpy(zero_copy_only=False)
            got, size = [], 0
            for data, off, rows in tb.slices(batch.column(1), SLICE_BYTES, whole=True):
                anchor, _, _, piece = snippets(data, off)
                got.append((anchor, place[rows[piece]], np.arange(len(piece)) - _runs_in_doc(piece, len(rows))[piece]))
                size += len(data)
                if size >= PACK_BYTES:
                    yield from packed(got)
                    got, size = [], 0
            if got:
                yield from packed(got)
            del got
            tb.release()

    return run


def _stream(batches):
    """(first column, list of rows as tuples) of each run of equal first columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != key and rows:
                yield key, rows
                rows = []
            key = row[0]
            rows.append(row)
    if rows:
        yield key, rows


def candidate_rows(batches):
    """(place, run) of each run whose anchor occurs more than once."""
    for _, rows in _stream(batches):
        size = [len(r[3]) // 4 for r in rows]
        ordinal = np.frombuffer(_plain([r[5] for r in rows], [2 * n for n in size]), "<u2").astype(np.int64)
        run = np.frombuffer(_plain([r[6] for r in rows], [4 * n for n in size]), "<u4")
        place = np.repeat(np.array([r[2] for r in rows], np.int64), size) << _GROUP | ordinal
        known = np.repeat(np.array([r[1] for r in rows]), size)
        ask = np.flatnonzero(~known)
        anchor = np.frombuffer(b"".join(r[3] for r in rows), "<u4").astype(np.uint64)
        anchor |= np.frombuffer(b"".join(r[4] for r in rows), "u1").astype(np.uint64) << np.uint64(32)
        order, start, _ = _grouped(anchor[ask], stable=False)
        count = np.diff(np.r_[start, len(ask)])
        hit = ask[order[np.repeat((count > 1), count)]]
        want = np.r_[np.flatnonzero(known), hit[ordinal[hit] != _SENT]]
        place, run = place[want], run[want].astype(np.int32)
        for k in range(0, len(want), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(place[k : k + (1 << 18)]), pa.array(run[k : k + (1 << 18)])], ["__place", "run"])
        del ordinal, run, place, known, anchor, order, hit, want, rows
        tb.release()


SNIPPETS = "shard int, sizes binary, content binary, counts binary, members binary"


def snippet_rows(shards: int):
    """Packs the candidate snippets of (place, id, text, lists of runs) by shard."""

    def run(batches):
        for batch in batches:
            place, ident = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            numbers, ends = batch.column(3).flatten().to_numpy(zero_copy_only=False), batch.column(3).offsets.to_numpy()
            ends = ends - ends[0]
            for data, off, rows in tb.slices(batch.column(2), SLICE_BYTES, whole=True):
                anchor, first, last, piece = snippets(data, off)
                base = _runs_in_doc(piece, len(rows))
                want = np.zeros(len(anchor), bool)
                a, b = ends[rows[0]], ends[rows[-1] + 1]
                want[numbers[a:b] + np.repeat(base[:-1], np.diff(ends[rows[0] : rows[-1] + 2]))] = True
                k = np.flatnonzero(want)
                if not len(k):
                    continue
                start, end = first[k], last[k] + MATCH
                one, same = tb.distinct(tb.span_hashes(data, start, end, lower=False))
                member = np.empty(len(k), MEMBER)
                member["place"], member["id"], member["start"] = place[rows[piece[k]]], ident[rows[piece[k]]], start - off[piece[k]]
                shard = (tb.mix64(anchor[k[one]] ^ np.uint64(0x5BF03635)) % np.uint64(shards)).astype(np.int32)
                order, cut, value = _grouped(shard)
                rank = np.empty(len(one), np.int64)
                rank[order] = np.arange(len(one))
                size = (end - start)[one][order]
                at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[one][order], size)
                by_content = tb.stable_order(rank[same])
                count = np.bincount(rank[same], minlength=len(one))
                before = lambda v: np.r_[0, np.cumsum(v)][cut]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.astype(np.int32)), _blobs(size.astype("<u4"), cut), _squeezed(data[at], before(size)), _blobs(count.astype("<u4"), cut), _squeezed(member[by_content], before(count))],
                    ["shard", "sizes", "content", "counts", "members"],
                )
            tb.release()

    return run


def _distinct(content: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one, same): a snippet of each content, and each snippet's; by hash, then by the bytes themselves."""
    h, cuts = np.empty(len(size), np.uint64), [*range(0, len(size), SNIPPETS_AT_ONCE), len(size)]
    for a, b in itertools.pairwise(cuts):
        h[a:b] = tb.span_hashes(np.asarray(content[start[a] : start[b - 1] + size[b - 1]]), start[a:b] - start[a], start[a:b] + size[a:b] - start[a], lower=False)
    one, same = tb.distinct(h)
    like = one[same]
    for a, b in itertools.pairwise(cuts):
        if not (size[like[a:b]] == size[a:b]).all() or not (content[_positions(start[like[a:b]], size[a:b])] == content[start[a] : start[b - 1] + size[b - 1]]).all():
            seen: dict[bytes, int] = {}  # two contents of one hash
            same = np.array([seen.setdefault(bytes(content[x : x + n]), len(seen)) for x, n in zip(start.tolist(), size.tolist(), strict=True)])
            return np.unique(same, return_index=True)[1], same
    return one, same


def _positions(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All positions of spans, one after another."""
    return np.arange(int(size.sum())) + np.repeat(start - np.cumsum(size) + size, size)


def shard_marks(size: np.ndarray, content: np.ndarray, count: np.ndarray, member: np.ndarray, memory: int = MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, span) arrays of the runs of windows that occur with a smaller id, of one shard's snippets."""
    start = np.cumsum(size) - size
    one, same = _distinct(content, start, size)
    owner = np.repeat(same, count)  # distinct snippet of each member
    _, rank = tb.distinct(member["id"])  # ids by their order among those of the shard
    rank = rank.astype(np.int32)
    least = np.full(len(one), len(member), np.int32)
    np.minimum.at(least, owner, rank)
    length, first = size[one], start[one]
    begin = np.cumsum(length + 1) - length - 1
    n = int((length + 1).sum())
    text, snippet, starts = room(n + _PAD, np.uint8, memory), room(n, np.int32, memory), room(n, bool, memory)
    for a in range(0, len(one), SNIPPETS_AT_ONCE):
        b = min(a + SNIPPETS_AT_ONCE, len(one))
        # UTF-8 has no byte 0xFF, so that all bytes can be raised by one and 0 is free
        text[_positions(begin[a:b], length[a:b])] = content[_positions(first[a:b], length[a:b])] + np.uint8(1)
        x, y = begin[a], begin[b - 1] + length[b - 1] + 1
        snippet[x:y] = np.repeat(np.arange(a, b, dtype=np.int32), length[a:b] + 1)
        starts[x:y] = np.arange(x, y) <= np.repeat(begin[a:b] + length[a:b] - MATCH, length[a:b] + 1)  # a window starts here
    # windows that are equal are a group; the smallest id of each
    number_type = np.int32 if n < 1 << 31 else np.int64
    group, smallest, groups = room(n, number_type, memory), room(n, np.int32, memory), -1
    for order, new in repeat_chunks(text, n, MATCH, memory):
        inside = starts[order]
        number = groups + np.cumsum(new, dtype=number_type)
        groups = int(number[-1])
        order, number = order[inside], number[inside]
        if not len(order):
            continue
        group[order] = number
        cut = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        low, at = np.minimum.reduceat(least[snippet[order]], cut) + np.int32(1), number[cut]
        known = smallest[at[0]]  # of a group that goes on; 0 if it is new, as ranks are kept from 1
        smallest[at] = low
        if known:
            smallest[at[0]] = min(known, low[0])
    # windows of each member that have a smaller id elsewhere
    windows = (length - MATCH + 1)[owner]
    for a in range(0, len(member), SNIPPETS_AT_ONCE):
        some, n_windows = member[a : a + SNIPPETS_AT_ONCE], windows[a : a + SNIPPETS_AT_ONCE]
        row = np.repeat(np.arange(len(some)), n_windows)
        at = _positions(begin[owner[a : a + SNIPPETS_AT_ONCE]], n_windows)
        j = at - begin[owner[a : a + SNIPPETS_AT_ONCE]][row]
        mark = smallest[group[at]] <= rank[a : a + SNIPPETS_AT_ONCE][row]
        turn_on = mark.copy()
        turn_on[1:] &= ~mark[:-1] | (row[1:] != row[:-1])
        turn_off = mark.copy()
        turn_off[:-1] &= ~mark[1:] | (row[1:] != row[:-1])
        x, y = np.flatnonzero(turn_on), np.flatnonzero(turn_off)
        who = row[x]
        yield some["place"][who], (some["start"][who].astype(np.int64) + j[x]) << 32 | (j[y] - j[x] + MATCH)


def mark_rows(batches):
    """(place, span) of a stream of packed snippets, sorted by shard; a span is start << 32 | length."""
    for _, rows in _stream(batches):
        size, count = (np.frombuffer(b"".join(r[c] for r in rows), "<u4").astype(np.int64) for c in (1, 3))
        content, member, a, b = room(int(size.sum()), np.uint8), room(int(count.sum()), MEMBER), 0, 0
        for r in rows:
            n, m = int(np.frombuffer(r[1], "<u4").sum(dtype=np.int64)), int(np.frombuffer(r[3], "<u4").sum(dtype=np.int64))
            content[a : a + n] = np.frombuffer(pa.decompress(r[2], n, "zstd", asbytes=True), np.uint8)
            member[b : b + m] = np.frombuffer(pa.decompress(r[4], m * MEMBER.itemsize, "zstd", asbytes=True), MEMBER)
            a, b = a + n, b + m
        del rows
        for place, span in shard_marks(size, content, count, member):
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(span)], ["place", "span"])
        del size, count, content, member
        tb.release()


def union_spans(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs (start, end) covered by packed spans."""
    if not len(spans):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    spans = np.sort(spans)
    a, b = spans >> 32, (spans >> 32) + (spans & 0xFFFFFFFF)
    reach = np.maximum.accumulate(b)
    first = np.flatnonzero(np.r_[True, a[1:] > reach[:-1]])
    return a[first], reach[np.r_[first[1:] - 1, len(a) - 1]]


def repeat_marks(rows: DataFrame, total_bytes: int) -> DataFrame:
    """(__place, __marks) of the rows of (__place, __id, __text) that repeat others."""
    parts, shards = max(1, -(-total_bytes // PART_BYTES)), max(1, -(-total_bytes // SHARD_BYTES))
    packed = rows.select("__place", "__text").mapInArrow(anchor_rows(parts), PACKED)
    answers = packed.repartition(min(parts, TASKS), "part").sortWithinPartitions("part").mapInArrow(candidate_rows, "__place bigint, run int")
    runs = answers.groupBy("__place").agg(F.collect_list("run").alias("runs"))
    again = rows.join(runs, "__place").select("__place", F.coalesce(F.col("__id").cast("bigint"), F.lit(LAST_ID)).alias("id"), "__text", "runs")
    sent = again.mapInArrow(snippet_rows(shards), SNIPPETS)
    marks = sent.repartition(min(shards, TASKS), "shard").sortWithinPartitions("shard").mapInArrow(mark_rows, "__place bigint, span bigint")
    return marks.groupBy("__place").agg(F.collect_list("span").alias("__marks"))


def _kept(value: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    if not len(start):
        return value
    cuts = [0, *np.stack([start, end], 1).ravel().tolist(), len(value)]
    return b"".join(value[cuts[k] : cuts[k + 1]] for k in range(0, len(cuts), 2))


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", out: str = "spans", kept: str | None = None, digest: str | None = None) -> DataFrame:
    """The documents with the byte spans (start, end) that occur in documents of smaller id.

    ``kept`` names a column for the text without them (characters that a span
    cuts through go as well), ``digest`` one for the SHA-256 of the bytes outside.
    """
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    made = [c for c in (out, kept, digest) if c]
    rest = [c for c in docs.columns if c not in (*made, id_col, text)]
    rows = placed(docs, "__place").select("__place", F.col(id_col).alias("__id"), F.col(text).alias("__text"), *(F.col(f"`{c}`") for c in rest))
    marks = repeat_marks(rows, total)

    def unite(texts: pa.Array, col: pa.Array) -> pa.Array:
        lists = [union_spans(np.array(x or [], np.int64)) for x in col.to_pylist()]
        n = np.array([len(a) for a, _ in lists])
        flat = [np.concatenate([x[i] for x in lists]) if lists else np.empty(0, np.int64) for i in (0, 1)]
        spans = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.StructArray.from_arrays([pa.array(f) for f in flat], ["start", "end"]))
        left = [_kept(v or b"", a, b) for v, (a, b) in zip(texts.cast(pa.binary()).to_pylist(), lists, strict=True)] if kept or digest else []
        cols = {"spans": spans}
        if kept:
            cols["kept"] = pa.array([v.decode("utf-8", "ignore") for v in left], pa.string())
        if digest:
            cols["digest"] = pa.array([hashlib.sha256(v).hexdigest() for v in left], pa.string())
        return pa.StructArray.from_arrays(list(cols.values()), list(cols))

    kind = "spans array<struct<start:bigint,end:bigint>>" + ", kept string" * bool(kept) + ", digest string" * bool(digest)
    columns = {id_col: F.col("__id"), text: F.col("__text")}
    joined = rows.join(marks, "__place", "left").withColumn("__cut", F.arrow_udf(unite, kind)("__text", "__marks"))
    names = {out: "spans", kept: "kept", digest: "digest"}
    return joined.select(*(columns.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns if c not in made), *(F.col(f"__cut.{names[c]}").alias(c) for c in made))


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What repeats of every document's bytes; see the module for the defined cases."""
    got = with_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), digest="kept_sha256")
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    row = got.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256",
    )
    return row.hint("rebalance")  # the rows are short: few files instead of one for each task of the texts
