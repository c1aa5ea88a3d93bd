"""Deleted interpolation against dictionaries, over packs and shards of any size, and odd texts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from knnloom.llm import interpolation, queries
from knnloom.llm.labelled import fold

from ..conftest import DATA

START, END = object(), object()


def tokens(text, order):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [START] * (order - 1) + [w for w in re.split("[ \t-\r]+", lowered) if w] + [END]


def grams(ts, order, k):
    """(n-gram, context) of order k (from 1) at each token."""
    return [(tuple(ts[i - k + 1 : i + 1]), tuple(ts[i - k + 1 : i])) for i in range(order - 1, len(ts))]


def dictionary_scores(rows, order):
    """[(n_tokens, n_known, N, base, score)] of rows (key, text)."""
    part = [zlib.crc32(str("" if i is None else i).encode()) % 7 for i, _ in rows]
    texts = [tokens(t, order) for _, t in rows]
    n, c, less_n, less_c = (Counter() for _ in range(4))
    for ts, p in zip(texts, part, strict=True):
        if p != 2:
            for k in range(1, order + 1):
                for g, before in grams(ts, order, k):
                    for grown, whole in ((g, n), ((k, before), c)):
                        whole[grown] += 1
                    if p == 3:
                        less_n[g] += 1
                        less_c[k, before] += 1
    words = lambda count: [g for g, m in count.items() if len(g) == 1 and m > 0]
    total, kinds = c[1, ()], len(words(n))
    left_n, left_c = (Counter({g: m - b[g] for g, m in a.items()}) for a, b in ((n, less_n), (c, less_c)))
    left_kinds, share = len(words(left_n)), {}

    def levels(g, counts, contexts, v):
        """[(own part, probability so far, bucket)] from order 1 up for one full n-gram."""
        p, out = 1 / (v + 1), []
        for k in range(1, order + 1):
            part_, m = g[order - k :], contexts[k, g[order - k : -1]]
            b = (k, m.bit_length())
            w = share.get(b, 0.5) if m else 0.0
            own = w * counts[part_] / m if m else 0.0
            p = own + (1 - w) * p
            out.append((own, p, b))
        return out

    deleted = [g for ts, p in zip(texts, part, strict=True) if p == 3 for g, _ in grams(ts, order, order)]
    for _ in range(interpolation.STEPS):
        take, all_ = Counter(), Counter()
        for g in deleted:
            stay = 1.0
            for own, p, b in reversed(levels(g, left_n, left_c, left_kinds)):
                take[b] += stay * own / p
                all_[b] += stay
                stay -= stay * own / p
        new = {b: min(max(take[b] / m, 0), interpolation.SURE) for b, m in all_.items() if m > 0}
        moved = max((abs(new[b] - share.get(b, 0.5)) for b in new), default=0)
        share = new
        if moved < interpolation.SETTLED:
            break
    out = []
    for ts in texts:
        full = [g for g, _ in grams(ts, order, order)]
        base = sum(math.log10((n[g[-1:]] + 1) / (total + kinds + 1)) for g in full)
        out.append((len(full), sum(n[g[-1:]] > 0 for g in full), total, base, sum(math.log10(levels(g, n, c, kinds)[-1][1]) for g in full)))
    return out


def held_against(got, rows, order):
    want = dictionary_scores(rows, order)
    assert len(got) == len(want)
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    for a, b in zip(sorted(map(key, got)), sorted((key((i, *w)) for (i, _), w in zip(rows, want, strict=True))), strict=True):
        assert a[:5] == b[:5]
        assert np.allclose(a[5:], b[5:], rtol=1e-4, atol=1e-6)


def run(frame, order=interpolation.ORDER, keep=("doc_id",)):
    part = fold(F.col("doc_id"), 7)
    return interpolation.scored(frame, list(keep), part != 2, part == 3, order=order)


def test_query_against_dictionaries(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op13_interpolation"](spark, f"{DATA}/sf0.001").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in got)
    held_against([(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got], rows, interpolation.ORDER)


@pytest.mark.parametrize(("order", "rows_in_pack", "shard_bytes", "held"), [(1, 1024, 8 << 20, 1 << 22), (2, 1, 1000, 1), (3, 3, 2000, 50), (2, 1024, 500, 1 << 22)])
def test_odd_texts_in_packs_and_shards_of_any_size(spark, odd, monkeypatch, order, rows_in_pack, shard_bytes, held):
    more = [(100 + i, "one two three two one two " * (i % 4) + f"Item{i} two") for i in range(60)]
    short = odd.where("doc_id is null or doc_id not in (6, 7)").select("doc_id", "text", "score", F.col("size").alias("n_tokens"))  # dictionaries of the long texts take long
    frame = short.unionByName(spark.createDataFrame(more, "doc_id bigint, text string"), allowMissingColumns=True).repartition(3)
    for name, value in (("PACK_ROWS", rows_in_pack), ("SHARD_BYTES", shard_bytes), ("HELD", held), ("LONG_BYTES", 100)):
        monkeypatch.setattr(interpolation, name, value)
    rows = [tuple(r) for r in frame.select("doc_id", "text").collect()]
    held_against([tuple(r) for r in run(frame, order).collect()], rows, order)


def test_long_and_equal_texts_and_empty_tables(spark, odd, none):
    got = run(odd, keep=("doc_id", "text", "lang")).collect()
    assert len(got) == odd.count()
    seen = {}
    for r in got:
        assert seen.setdefault(r["text"] or "", (r["n_tokens"], r["n_known"], r["base_score"], r["score"])) == (r["n_tokens"], r["n_known"], r["base_score"], r["score"])
        assert r["n_tokens"] == len(tokens(r["text"], 1)) and r["score"] < 0 and r["base_score"] < 0
    assert run(none).count() == 0
    nothing = odd.where("doc_id = 1").select((F.col("doc_id") * 0 + next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)).alias("doc_id"), "text")
    r = run(nothing).first()
    assert (r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (0, 0, 0.0, 0.0)


def test_scores_beat_single_tokens_on_held_out_rows(spark):
    got = queries.QUERIES["op13_interpolation"](spark, f"{DATA}/sf0.01").where("held_out").toPandas()
    assert got["score"].sum() > got["base_score"].sum() + 0.4 * got["n_tokens"].sum()
    assert (got["score"] > got["base_score"]).mean() > 0.9


def test_planes():
    for a in ([], [0], [1, 255], [256, 0, 7], [1 << 61, 3]):
        a = np.array(a, np.uint64)
        assert (interpolation.unpacked(interpolation.packed(a), len(a)) == a).all()


def test_distinct_rows():
    rng = np.random.default_rng(5)
    for most in (3, 1 << 40):
        x = rng.integers(0, most, (200, 4))
        x = x[rng.integers(0, 200, 900)]
        got, times = interpolation.distinct_rows(x)
        assert {tuple(r): t for r, t in zip(got.tolist(), times.tolist(), strict=True)} == Counter(map(tuple, x.tolist()))
