"""Near-duplicates by resemblance: the Jaccard similarity of sets of word shingles.

Two texts are linked if the sets of their shingles of ``words`` words have a
similarity of ``least`` or more.  Candidates come from the SimHashes of the sets, by
the search that ``resembling`` is given, and from BANDS keys a text, each of ROWS
minima of the shingles under one order each (MinHash), for what that search misses;
every candidate is verified on the shingles themselves, so no link is false.  At a
similarity of 0.8 all keys of a pair differ with a chance of (1 - 0.8^5)^32 = 3e-6.

Equal texts are joined first.  In each key all members are compared with one of
them; where the members of a key are then not of one component, they are dealt
into blocks, and all pairs of blocks are compared by matrix products.

Defined cases.  Null text: as empty.  Texts without words are equal.  Texts with
fewer words than a shingle are one shingle.  Words are runs of bytes that are not
white space, with A-Z lower-cased.  Ids may repeat; a component whose ids are all
null has a null id.  Very long texts are read whole.  An empty table gives an
empty result.  Other columns are neither read nor changed.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .components import components
from .session import pinned

WORDS, LEAST = 5, 0.8
BANDS, ROWS = 32, 5
#: Pairs of one text that one task verifies, about; members of a block, about, and shingles of a matrix.
PART, COLUMNS = 256, 8192
SEED = 6
#: Near pairs (u, v) of distinct SimHashes (fp).
Search = Callable[[DataFrame], DataFrame]

_ODD = tb._odd(SEED, BANDS * ROWS)
_FLIP = tb.mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TURN = tb._odd(SEED + 1, 64)


def shingles(col: pa.Array, words: int = WORDS):
    """(rows, bounds, hashes) of one slice of texts after another: each text's distinct shingles, sorted."""
    for data, off, rows in tb.slices(col, whole=True):
        ws, we, wp = tb.words(data, off)
        h = tb.span_hashes(data, ws, we)
        n = np.bincount(wp, minlength=len(rows))
        first = np.cumsum(n) - n
        grams = np.where(n > 0, np.maximum(n - words + 1, 1), 0)
        piece = np.repeat(np.arange(len(rows)), grams)
        a = np.arange(len(piece)) - np.repeat(np.cumsum(grams) - grams, grams) + first[piece]
        size = np.minimum(n, words)[piece]
        g = size.astype(np.uint64)
        for k in range(words):
            has = k < size
            g[has] += h[a[has] + k] * _TURN[k]
        g = tb.mix64(g)
        order = np.lexsort((g, piece))
        g, piece = g[order], piece[order]
        new = np.r_[True, (g[1:] != g[:-1]) | (piece[1:] != piece[:-1])] if len(g) else np.empty(0, bool)
        yield rows, np.r_[0, np.cumsum(np.bincount(piece[new], minlength=len(rows)))], g[new]


def _minima(g: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    return np.minimum.reduceat((g ^ _FLIP[k]) * _ODD[k], starts)


def _digest(g: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    return tb.mix64(np.add.reduceat(tb.mix64(g ^ _FLIP[0]), starts) + size.astype(np.uint64))


def keys_of(words: int):
    """A UDF's body: digest of a text's shingles, their SimHash and their keys."""

    def run(col: pa.Array) -> pa.Array:
        digest, prints, keys = np.zeros(len(col), np.uint64), np.zeros(len(col), np.uint64), np.zeros((len(col), BANDS), np.uint64)
        for rows, bounds, g in shingles(col, words):
            full = np.flatnonzero(np.diff(bounds))
            if not len(full):
                continue
            at, starts = rows[full], bounds[full]
            digest[at], prints[rows] = _digest(g, starts, np.diff(bounds)[full]), tb.majority(g, bounds)
            for b in range(BANDS):
                key = np.full(len(full), b + 1, np.uint64)
                for k in range(b * ROWS, (b + 1) * ROWS):
                    key = tb.mix64(key * _TURN[1] + _minima(g, starts, k))
                keys[at, b] = key
        lists = pa.ListArray.from_arrays(pa.array((np.arange(len(col) + 1) * BANDS).astype(np.int32)), pa.array(keys.ravel().view(np.int64)))
        tb.release()
        return pa.StructArray.from_arrays([pa.array(digest.view(np.int64)), pa.array(prints.view(np.int64)), lists], ["h", "fp", "keys"])

    return run


def sets_of(words: int):
    """A UDF's body: digest of a text's shingles and the shingles."""

    def run(col: pa.Array) -> pa.Array:
        digest, size, held = np.zeros(len(col), np.uint64), np.zeros(len(col), np.int64), [np.empty(0, np.uint64)]
        for rows, bounds, g in shingles(col, words):
            held.append(g)
            full = np.flatnonzero(np.diff(bounds))
            if len(full):
                size[rows] = np.diff(bounds)
                digest[rows[full]] = _digest(g, bounds[full], size[rows[full]])
        flat = pa.array(np.concatenate(held).view(np.int64))
        out = pa.StructArray.from_arrays([pa.array(digest.view(np.int64)), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), flat)], ["h", "shingles"])
        tb.release()
        return out

    return run


KEYED = "struct<h:bigint,fp:bigint,keys:array<bigint>>"
SET = "struct<h:bigint,shingles:array<bigint>>"


def verified(least: float):
    """(u, v) of the rows (u, v, a, b) whose sorted sets a and b are similar enough."""

    def run(batches):
        for batch in batches:
            u, v, a, b = batch.columns
            parts = [(x.flatten().to_numpy(), np.r_[0, np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))]) for x in (a, b)]
            ok = np.zeros(len(u), bool)
            for i in range(len(u)):
                x, y = (flat[at[i] : at[i + 1]] for flat, at in parts)
                if min(len(x), len(y)) < least * max(len(x), len(y)):
                    continue
                z = np.concatenate((x, y))
                z.sort()
                both = int(np.count_nonzero(z[1:] == z[:-1]))
                ok[i] = both >= least * (len(z) - both) - 1e-9
            yield pa.RecordBatch.from_arrays([u.filter(pa.array(ok)), v.filter(pa.array(ok))], ["u", "v"])

    return run


def _links_of(h: np.ndarray, c: np.ndarray, flat: np.ndarray, size: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between sets of different components, by products of 0/1 matrices over some shingles at a time."""
    value, at = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(h)), size)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    both = np.zeros((len(h), len(h)), np.float32)
    for lo in range(0, len(value), COLUMNS):
        a, b = np.searchsorted(at, (lo, lo + COLUMNS))
        has = np.zeros((len(h), min(COLUMNS, len(value) - lo)), np.float32)
        has[owner[a:b], at[a:b] - lo] = 1
        both += has @ has.T
    near = (both >= least * (size[:, None] + size[None, :] - both) - 1e-6) & (c[:, None] < c[None, :])
    i, j = np.nonzero(near)
    # A link for each pair of components is enough.
    _, first = np.unique(np.stack((c[i], c[j]), 1), axis=0, return_index=True)
    return h[i[first]], h[j[first]]


def compared(least: float):
    """Links of the block pairs of rows (key, lo, hi, h, component, set) sorted by the first three."""

    def work(table):
        x = table.column(5).combine_chunks()
        u, v = _links_of(table.column(3).to_numpy(), table.column(4).to_numpy(), x.flatten().to_numpy(), x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), least)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            pair = np.stack([table.column(k).to_numpy() for k in range(3)], 1)
            cuts = np.r_[0, np.flatnonzero((pair[1:] != pair[:-1]).any(1)) + 1]
            for a, b in itertools.pairwise(cuts.tolist()):
                yield work(table.slice(a, b - a))
            held = table.slice(int(cuts[-1]))
        if held is not None and held.num_rows:
            yield work(held)
        tb.release()

    return run


def _verify(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs that are links; a text of many pairs is copied to many tasks."""
    pairs = pinned(pairs.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "none")
    hubs = pairs.groupBy("u").agg(F.ceil(F.count("*") / PART).alias("n"))
    dealt = pairs.join(hubs, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("n")).alias("part"))
    left = sets.join(hubs, F.col("h") == F.col("u")).select("u", F.col("shingles").alias("a"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("part"))
    whole = dealt.join(left, ["u", "part"]).join(sets.select(F.col("h").alias("v"), F.col("shingles").alias("b")), "v")
    return pinned(whole.select("u", "v", "a", "b").mapInArrow(verified(least), "u bigint, v bigint"), "none")


def by_prints(keyed: DataFrame, search: Search) -> DataFrame:
    """Candidate pairs (u, v) of distinct sets (h, fp): of one print, and of prints that the search links."""
    first = pinned(keyed.groupBy("fp").agg(F.min("h").alias("h")), "none")
    same = keyed.join(first.select("fp", F.col("h").alias("u")), "fp").select("u", F.col("h").alias("v"))
    found = search(first.select("fp")).select(F.col("u").alias("a"), F.col("v").alias("b")).distinct()
    of = lambda end, name: first.select(F.col("fp").alias(end), F.col("h").alias(name))
    linked = found.join(of("a", "u"), "a").join(of("b", "v"), "b").select("u", "v")
    return pinned(same.unionByName(linked).where("u != v"), "none")


def links(keyed: DataFrame, texts: DataFrame, words: int, least: float, search: Search | None = None) -> DataFrame:
    """Edges (u, v) that connect the distinct sets (h, fp, keys) of the texts as all links do."""
    pairs_by_print = by_prints(keyed.select("h", "fp"), search) if search else None
    keys = keyed.select("h", F.explode("keys").alias("key"))
    groups = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("h").alias("u")).where("n > 1")
    members = pinned(keys.join(groups, "key").select("key", "n", "u", F.col("h").alias("v")), "none")
    asked, named = members.select("u", "v"), members.select(F.col("v").alias("h"))
    if pairs_by_print is not None:
        asked = asked.unionByName(pairs_by_print)
        named = named.unionByName(pairs_by_print.select(F.explode(F.array("u", "v")).alias("h")))
    # The shingles of texts that share a key are made again; those of all texts are not kept.
    made = texts.select(F.arrow_udf(sets_of(words), SET)(F.col("text")).alias("x")).select("x.*")
    sets = pinned(made.join(named.distinct(), "h", "left_semi").dropDuplicates(["h"]), "none")
    first = _verify(asked, sets, least)
    roots = pinned(components(first, first.count()), "none")
    # Members of keys of three and more, where these aren't of one component, in blocks that are compared in pairs.
    more = members.where("n > 2").join(roots.withColumnRenamed("node", "v"), "v", "left").select("key", "n", "v", F.coalesce("root", "v").alias("c"))
    mixed = more.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("z")).where("a != z").select("key")
    block = more.join(mixed, "key").withColumn("parts", F.ceil(F.col("n") / PART)).withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")))
    pairs = block.select("key", "v", "c", "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("other"))
    pairs = pairs.select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "v", "c")
    filled = pairs.join(sets.select(F.col("h").alias("v"), "shingles"), "v").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    second = filled.select("key", "lo", "hi", "v", "c", "shingles").mapInArrow(compared(least), "u bigint, v bigint")
    return first.unionByName(pinned(second, "none"))


def resembling(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS, least: float = LEAST, search: Search | None = None) -> DataFrame:
    """(id, component_id) of each row: the smallest id that links of this similarity reach.

    ``search`` gives pairs (u, v) of SimHashes (fp), the candidates that are taken first.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    made = pinned(texts.select("id", F.arrow_udf(keys_of(words), KEYED)(F.col("text")).alias("x")).select("id", "x.*"), "none")
    prints = made.select("id", "h")
    edges = links(made.drop("id").where("h != 0").dropDuplicates(["h"]), texts, words, least, search)
    roots = components(edges, edges.count())
    distinct = prints.groupBy("h").agg(F.min("id").alias("least"))
    rooted = distinct.join(roots.withColumnRenamed("node", "h"), "h", "left").select("h", "least", F.coalesce("root", "h").alias("root"))
    smallest = pinned(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "none")  # so that a large root's rows can be split at the join
    of_set = rooted.select("h", "root").join(smallest, "root").select("h", "component_id")
    return prints.join(of_set, "h").select("id", "component_id")
