"""Log-probabilities of texts by deleted interpolation of word n-grams.

Tokens are words in lower case (A-Z only), then one end.  The probability of a
token mixes maximum-likelihood estimates of falling order: an n-gram's count
over its context's, with weight l(b), and the mixture of the order below with
1 - l(b), down to an equal share for each known token and one unknown.  The
weight depends on the bucket b of the context's count, by its number of binary
digits.  Weights are learned by expectation-maximisation: the n-grams of one part
of the training rows are taken from the counts ("deleted") and weigh the estimates
that are left.  The scores use the counts of all training rows.

Nothing is broadcast but the weights.  Rows lie in packs by their place, long texts
alone.  A pack sends each of its n-grams once, as sorted 60-bit hashes in delta
form, to the shard of the hash's range; a shard adds the counts up and answers each
pack in the pack's own order; the pack's texts meet the answers and look their
tokens up.  All of that grows with the corpus, shards and packs in number and not
in size.  A frequent n-gram comes once from each pack.

Defined cases.  Null text: as empty, which is the end alone.  A null key is in the
fold of the empty text.  Repeated rows count each time, and equal texts score
alike.  Very long texts are read whole.  An unseen context gives no weight to its
order; weights nothing was learned for are 1/2.  Without training rows N and V are
0 and every token is the unknown one.  Two n-grams of equal hash would share their
count: with 10^9 kinds of words one pair is to be expected half the time.  The
text isn't in the result; of the other columns those are kept that are asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textbytes as tb
from .labelled import fold
from .session import pinned, placed

ORDER = 2
#: Rows in a pack, bytes of a text that is a pack of its own, and bytes of text for each shard.
PACK_ROWS, LONG_BYTES, SHARD_BYTES = 1024, 1 << 16, 8 << 20
#: N-grams held by a task before it sends them.
HELD = 1 << 22
#: Tokens of the deleted part whose counts are added up at once.
TUNED = 1 << 19
#: Steps of expectation-maximisation at most, the change of a weight that ends them, and the largest weight.
STEPS, SETTLED, SURE = 40, 1e-4, 1 - 1e-6
#: Expected counts are added up in units of this share, so that their order doesn't matter.
UNIT = 1 << 20
BUCKETS = 64
_END, _START = np.uint64(0x8F3A1C5D7E92B461), np.uint64(0x51C64E6DB7A09D13)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def gram_keys(data: np.ndarray, off: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(keys [order, tokens], bounds of each piece's tokens); a key's last four bits are left for order and flags."""
    s, e, piece = tb.words(data, off)
    n = np.bincount(piece, minlength=len(off) - 1)
    bounds = np.r_[0, np.cumsum(n + 1)]
    token = np.full(int(bounds[-1]), _END)
    token[np.arange(len(s)) + piece] = tb.span_hashes(data, s, e)
    grams, start = [token], _START
    for _ in range(order - 1):
        before = np.empty_like(token)
        before[1:] = grams[-1][:-1]
        before[bounds[:-1]] = start
        grams.append(tb.mix64(before * _STEP + token))
        start = tb.mix64(np.full(1, start) * _STEP + _START)[0]
    keys = np.stack(grams) & ~np.uint64(15)
    return keys | (np.arange(order, dtype=np.uint64) << np.uint64(2))[:, None], bounds


def packed(a: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, as many as the largest needs."""
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = np.frombuffer(data, np.uint8).reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel()


def _firsts(a: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of 62-bit keys (hash and order)."""
    return ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(30)).astype(np.int64)


SENT = "shard bigint, pack bigint, size bigint, keys binary, n binary, deleted binary"


def sent_keys(order: int, shards: int):
    """Rows of SENT from (pack, text, train, tune): each pack's distinct n-grams by shard, with their counts."""

    def rows_of(pack: int, parts: list[np.ndarray]):
        key = np.concatenate(parts)
        key.sort()
        one = key >> np.uint64(2)
        first = _firsts(one)
        n = np.add.reduceat(key >> np.uint64(1) & np.uint64(1), first)
        deleted = np.add.reduceat(key & np.uint64(1), first)
        one = one[first]
        to = shard_of(one, shards)
        cuts = [*_firsts(to).tolist(), len(to)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield int(to[a]), pack, b - a, packed(np.diff(one[a:b], prepend=np.uint64(0))), packed(n[a:b]), packed(deleted[a:b])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in SENT.split(", ")])

    def made(batches):
        held: dict[int, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            pack = batch.column(0).to_numpy(zero_copy_only=False)
            flags = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.uint64) for i in (2, 3)]
            flag = flags[0] << np.uint64(1) | flags[1]
            for data, off, rows in tb.slices(batch.column(1), whole=True):
                keys, bounds = gram_keys(data, off, order)
                keys |= np.repeat(flag[rows], np.diff(bounds))
                cuts = [*_firsts(pack[rows]).tolist(), len(rows)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    held.setdefault(int(pack[rows[a]]), []).append(keys[:, bounds[a] : bounds[b]].ravel())
                    size += held[int(pack[rows[a]])][-1].size
                if size > HELD:  # but the pack at hand, which may go on
                    for p in [p for p in held if p != pack[rows[-1]]]:
                        yield batch_of(list(rows_of(p, held.pop(p))))
                    size = sum(x.size for xs in held.values() for x in xs)
        for p, parts in held.items():
            yield batch_of(list(rows_of(p, parts)))
        tb.release()

    return made


COUNTED = "shard bigint, pack bigint, size bigint, n binary, deleted binary, kinds bigint, left_kinds bigint, tokens bigint, left_tokens bigint"


def counted(table: pa.Table) -> pa.Table:
    """Rows of COUNTED for one shard: the counts of each pack's n-grams, in order; and the shard's own sums, in its first row."""
    size = table["size"].to_numpy()
    pick = lambda name: [unpacked(b.as_py(), n) for b, n in zip(table[name], size.tolist(), strict=True)]
    key = np.concatenate([np.cumsum(d, dtype=np.uint64) for d in pick("keys")])
    order = np.argsort(key)
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    first = np.flatnonzero(new)
    n, deleted = (np.add.reduceat(np.concatenate(pick(name))[order], first) for name in ("n", "deleted"))
    word = key[order][first] & np.uint64(3) == 0
    same = np.empty(len(key), np.int64)
    same[order] = np.cumsum(new) - 1
    ends, pieces = np.cumsum(size), {}
    for i, p in enumerate(table["pack"].to_pylist()):
        pieces.setdefault(p, []).append(same[ends[i] - size[i] : ends[i]])
    rows = []
    for p, parts in pieces.items():
        at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        rows.append((table["shard"][0].as_py(), p, len(at), packed(n[at]), packed(deleted[at]), 0, 0, 0, 0))
    left = n - deleted
    rows[0] = (*rows[0][:5], int((n[word] > 0).sum()), int((left[word] > 0).sum()), int(n[word].sum()), int(left[word].sum()))
    tb.release()
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 4]
    return pa.table([pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in COUNTED.split(", ")])


@dataclass
class Sizes:
    """Training rows, tokens and kinds of tokens; ``left``: without the deleted part."""

    rows: int
    tokens: int
    kinds: int
    left_rows: int
    left_tokens: int
    left_kinds: int


def looked_up(keys: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    """For each key its place in each of the counts, which are in order of the distinct keys."""
    keys = keys >> np.uint64(2)
    order = np.argsort(keys)
    new = np.diff(keys[order], prepend=keys[order][:1]) > 0
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new)
    return [c[at] for c in counts]


def contexts(n: np.ndarray, bounds: np.ndarray, rows: int, tokens: int) -> np.ndarray:
    """The count of each token's context for each order: that of the n-gram one shorter and one place before."""
    c = np.empty_like(n)
    c[0] = tokens
    c[1:, 1:] = n[:-1, :-1]
    c[1:, bounds[:-1]] = rows
    return c


def bucket(c: np.ndarray) -> np.ndarray:
    """The number of binary digits of a count."""
    return np.frexp(c.astype(np.float64))[1]


def mixed(n: np.ndarray, c: np.ndarray, kinds: int, weights: np.ndarray) -> np.ndarray:
    """The probability of each token from the counts of its n-grams and contexts."""
    p = np.full(n.shape[1], 1.0 / (kinds + 1))
    for k in range(len(n)):
        share = np.where(c[k] > 0, weights[k][bucket(c[k])], 0.0)
        p = share * (n[k] / np.maximum(c[k], 1)) + (1 - share) * p
    return p


def learned(rows: DataFrame, order: int, kinds: int) -> np.ndarray:
    """Weights [order, BUCKETS] from rows (w; n, c, b of each order) of the deleted part, counted without it."""
    weights = np.full((order, BUCKETS), 0.5)
    names = [f"b{k}" for k in range(order)]
    for _ in range(STEPS):
        p, below = F.lit(1.0 / (kinds + 1)), []
        for k in range(order):
            share = F.when(F.col(f"c{k}") > 0, F.element_at(F.array(*map(F.lit, weights[k].tolist())), (F.col(f"b{k}") + 1).cast("int"))).otherwise(0.0)
            own = share * F.col(f"n{k}") / F.greatest(f"c{k}", F.lit(1))
            below.append((own, own + (1 - share) * p))
            p = below[-1][1]
        stay, sums = F.lit(1.0), []
        whole = lambda x: F.sum(F.round(x * F.col("w") * UNIT).cast("decimal(38,0)"))
        for k in reversed(range(order)):
            take = stay * below[k][0] / below[k][1]
            sums += [whole(take).alias(f"take{k}"), whole(stay).alias(f"stay{k}")]
            stay = stay - take
        got = rows.groupBy(*names).agg(*sums).collect()  # one row for each combination of buckets
        new = weights.copy()
        for k in range(order):
            take, all_ = np.zeros(BUCKETS), np.zeros(BUCKETS)
            for r in got:
                take[r[f"b{k}"]] += int(r[f"take{k}"])
                all_[r[f"b{k}"]] += int(r[f"stay{k}"])
            new[k] = np.where(all_ > 0, np.clip(take / np.maximum(all_, 1), 0.0, SURE), 0.5)
        moved = np.abs(new - weights).max()
        weights = new
        if moved < SETTLED:
            break
    return weights


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of whole numbers, and how often each occurs."""
    low = rows.min(0)
    bits = [int(x).bit_length() for x in rows.max(0) - low]
    if sum(bits) > 63:
        rows = rows[np.lexsort(rows.T)]
        first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(1)])
        return rows[first], np.diff(np.r_[first, len(rows)])
    one = np.zeros(len(rows), np.int64)
    for x, b in zip((rows - low).T, bits, strict=True):
        one = one << b | x
    _, first, times = np.unique(one, return_index=True, return_counts=True)
    return rows[first], times


def deleted_rows(order: int, sizes: Sizes):
    """(w; n, c, b of each order) from the counts of (size, n, deleted) of rows of the deleted part, equal ones added up, TUNED tokens at a time."""
    names = [f"{x}{k}" for x in "ncb" for k in range(order)]

    def added(found: list[np.ndarray]) -> pa.RecordBatch:
        kind, times = distinct_rows(np.concatenate(found))
        return pa.RecordBatch.from_arrays([pa.array(times), *(pa.array(x) for x in kind.T), *(pa.array(bucket(x).astype(np.int64)) for x in kind[:, order:].T)], ["w", *names])

    def made(batches):
        found, held = [], 0
        for batch in batches:
            size = batch.column(0).to_numpy(zero_copy_only=False)
            for i, m in enumerate(size.tolist()):
                n, gone = (unpacked(batch.column(j)[i].as_py(), m * order).reshape(order, m).astype(np.int64) for j in (1, 2))
                n -= gone
                c = contexts(n, np.array([0, m]), sizes.left_rows, sizes.left_tokens)
                b = bucket(c)
                c = np.where(n > 0, c, np.where(b > 0, 1 << np.maximum(b - 1, 0), 0))  # what wasn't seen is of one kind in a bucket
                found.append(np.concatenate([n, c]).T)
                held += m
                if held >= TUNED:
                    yield added(found)
                    found, held = [], 0
        if found:
            yield added(found)
        tb.release()

    return made, ", ".join(f"{x} bigint" for x in ["w", *names])


ADDED = "n_tokens bigint, n_known bigint, base_score double, __n binary, __deleted binary"


def scored(docs: DataFrame, keep: list[str], train: Column, tune: Column, text: str = "text", order: int = ORDER) -> DataFrame:
    """The ``keep`` columns of the documents with n_tokens, n_known, train_tokens, base_score and score.

    Learns from the rows where ``train`` holds; of these the part where ``tune``
    holds gives the deleted counts.  ``base_score`` is by single tokens, one added
    to each count.
    """
    if not 1 <= order <= 3:
        raise ValueError("order must be from 1 to 3")
    yes = lambda c: F.coalesce(c, F.lit(False))
    size = F.coalesce(F.octet_length(text), F.lit(0))
    rows = docs.withColumns({"__train": yes(train), "__tune": yes(train & tune)})
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count_if("__train").alias("rows"), F.count_if(F.col("__train") & ~F.col("__tune")).alias("left")).first()
    shards = max(1, -(-total["bytes"] // SHARD_BYTES))
    parts = max(1, -(-total["bytes"] // (2 * SHARD_BYTES)))
    rows = placed(rows.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("__text"), "__train", "__tune"), "__place")
    pack = F.when(F.octet_length("__text") > LONG_BYTES, -1 - F.col("__place")).otherwise(F.floor(F.col("__place") / PACK_ROWS)).alias("__pack")
    rows = rows.select(pack, "__text", "__train", "__tune", *(F.col(f"`{c}`") for c in keep))
    sent = rows.select("__pack", "__text", "__train", "__tune").mapInArrow(sent_keys(order, shards), SENT)
    counts = pinned(sent.repartition(shards, "shard").groupBy("shard").applyInArrow(counted, COUNTED))
    s = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("kinds", "left_kinds", "tokens", "left_tokens"))).first()
    sizes = Sizes(total["rows"], s["tokens"], s["kinds"], total["left"], s["left_tokens"], s["left_kinds"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("shard")
        number = right["size"].to_pylist()
        n, gone = (np.concatenate([unpacked(b.as_py(), m) for b, m in zip(right[name], number, strict=True)]) for name in ("n", "deleted"))
        pieces = [(at, *gram_keys(data, off, order)) for data, off, at in tb.slices(left["__text"], whole=True)]
        mine_all, less_all = looked_up(np.concatenate([keys.ravel() for _, keys, _ in pieces]), n, gone)
        out: list[tuple] = []
        done = 0
        for at, keys, bounds in pieces:
            mine, less = (c[done : done + keys.size].reshape(keys.shape) for c in (mine_all, less_all))
            done += keys.size
            base = tb.segment_sum(np.log10((mine[0] + np.uint64(1)).astype(float) / (sizes.tokens + sizes.kinds + 1)), bounds)
            seen = tb.segment_sum((mine[0] > 0).astype(np.int8), bounds)
            tuned = left["__tune"].take(pa.array(at)).to_pylist()
            for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False)):
                out.append((b - a, int(seen[i]), float(base[i]), packed(mine[:, a:b].ravel()), packed(less[:, a:b].ravel()) if tuned[i] else None))
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary())
        made = left.select(["__tune", *keep])
        for name, kind, values in zip([f.split()[0] for f in ADDED.split(", ")], kinds, zip(*out, strict=True), strict=True):
            made = made.append_column(name, pa.array(list(values), kind))
        tb.release()
        return made

    fields = {f.name: f for f in rows.schema.fields}
    schema = StructType([fields["__tune"], *(fields[c] for c in keep), *StructType.fromDDL(ADDED).fields])
    both = rows.repartition(parts, "__pack").groupBy("__pack").cogroup(counts.select(F.col("pack").alias("__pack"), "shard", "size", "n", "deleted").repartition(parts, "__pack").groupBy("__pack"))
    found = pinned(both.applyInArrow(meet, schema))
    made, columns = deleted_rows(order, sizes)
    apart = found.where("__tune").select("n_tokens", "__n", "__deleted").mapInArrow(made, columns)
    apart = pinned(apart.groupBy(*(c for c in apart.columns if c != "w")).agg(F.sum("w").alias("w")), "none")
    weights = learned(apart, order, sizes.left_kinds)

    def score(length: pa.Array, n: pa.Array) -> pa.Array:
        out = []
        for m, blob in zip(length.to_pylist(), n, strict=True):
            mine = unpacked(blob.as_py(), m * order).reshape(order, m).astype(np.int64)
            c = contexts(mine, np.array([0, m]), sizes.rows, sizes.tokens)
            out.append(float(np.log10(mixed(mine, c, sizes.kinds, weights)).sum()))
        return pa.array(out, pa.float64())

    value = F.arrow_udf(score, "double")("n_tokens", "__n")
    return found.select(*(F.col(f"`{c}`") for c in keep), "n_tokens", "n_known", F.lit(sizes.tokens).cast("bigint").alias("train_tokens"), "base_score", value.alias("score"))


def op13_interpolation(spark, sf_dir: str) -> DataFrame:
    """Log-probability of every document; see the module for the defined cases."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    part = fold(F.col("doc_id"), 7)
    out = scored(docs, ["doc_id"], part != 2, part == 3)
    return out.select("doc_id", (part == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
