"""The Kneser-Ney ratios against dictionaries, both ways of scoring, and the held-out rank."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from knnloom.llm import queries, toxicity
from knnloom.llm.toxicity import DISCOUNT, STRENGTH, fit_toxicity, with_toxicity

from ..conftest import DATA


def dictionary_ratios(rows):
    """{5-gram: ratio} of those seen, {4-gram: ratio of what follows it unseen}."""
    count = [Counter(), Counter()]
    for text, y in rows:
        low = bytes(32 if b in b" \t\n\v\f\r" else b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
        pad = b"    " + low
        for k in range(len(low)):
            count[y][pad[k : k + 5]] += 1
    kinds = {n: Counter() for n in range(1, 5)}
    level = set(count[0]) | set(count[1])
    for n in range(4, 0, -1):
        kinds[n] = Counter(g[1:] for g in level)
        level = set(kinds[n])
    total = {n: Counter() for n in range(2, 5)}
    follow = {n: Counter() for n in range(2, 5)}
    for n in range(2, 5):
        for g, c in kinds[n].items():
            total[n][g[:-1]] += c
            follow[n][g[:-1]] += 1

    def shared(g):
        if len(g) == 1:
            return (kinds[1][g] + 0.1) / (sum(kinds[1].values()) + 25.6)
        n = len(g)
        return (max(kinds[n][g] - DISCOUNT, 0) + DISCOUNT * follow[n][g[:-1]] * shared(g[1:])) / total[n][g[:-1]]

    all_, types = ([Counter(), Counter()] for _ in range(2))
    for y in (0, 1):
        for g, c in count[y].items():
            all_[y][g[:-1]] += c
            types[y][g[:-1]] += 1
    p = lambda g, y: (max(count[y][g] - DISCOUNT, 0) + (DISCOUNT * types[y][g[:-1]] + STRENGTH) * shared(g[1:])) / (all_[y][g[:-1]] + STRENGTH)
    back = lambda c, y: (DISCOUNT * types[y][c] + STRENGTH) / (all_[y][c] + STRENGTH)
    seen = {g: math.log(p(g, 1) / p(g, 0)) for g in set(count[0]) | set(count[1])}
    return seen, {c: math.log(back(c, 1) / back(c, 0)) for c in set(all_[0]) | set(all_[1])}


@pytest.fixture(scope="module")
def labelled(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    return [(r["text"], r["toxic"]) for r in docs.join(labels, "doc_id").where("toxic is not null").select("text", "toxic").collect()]


def test_ratios(spark, labelled):
    rows = [*labelled[:60], ("", 0), (None, 1), ("Ab", 1)]
    seen, unseen = dictionary_ratios(rows)
    got = {r["key"]: r["r"] for r in toxicity.ratio_rows(spark.createDataFrame(rows, "text string, y int")).collect()}
    want = {int.from_bytes(g, "big"): r for g, r in seen.items()} | {int.from_bytes(c, "big") | toxicity.CONTEXT: r for c, r in unseen.items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)


def test_features(labelled):
    seen, unseen = dictionary_ratios(labelled[:60])
    model = toxicity.Model(np.array([int.from_bytes(g, "big") for g in seen] + [int.from_bytes(c, "big") | toxicity.CONTEXT for c in unseen], np.uint64), np.array([*seen.values(), *unseen.values()]))
    texts = [t for t, _ in labelled[40:90]]
    for text, got in zip(texts, model.features(pa.array(texts)), strict=True):
        low = bytes(32 if b in b" \t\n\v\f\r" else b + 32 if 65 <= b <= 90 else b for b in text.encode())
        pad = b"    " + low
        r = [seen.get(pad[k : k + 5], unseen.get(pad[k : k + 4], 0.0)) for k in range(len(low))]
        words, k = [], 0
        while k < len(low):
            if low[k] == 32:
                k += 1
                continue
            end = next((j for j in range(k, len(low)) if low[j] == 32), len(low))
            words.append(sum(r[k : min(end + 1, len(low))]))
            k = end
        excess = sum(max(w - toxicity.WORD_NATS, 0) for w in words) / max(len(words), 1)
        assert got.tolist() == pytest.approx([sum(r) / max(len(r), 1), math.log1p(100 * excess), math.log1p(max([0, *words]))], abs=1e-4)


def test_score_counts_every_fold_but_the_held_out(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    some = docs.where("doc_id % 9 = 0")
    model = fit_toxicity(some, labels)
    rows = [r for r in some.join(labels.where("toxic is not null"), "doc_id").select("doc_id", "text", "toxic").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5]
    assert any(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1 for r in rows)
    seen, unseen = dictionary_ratios([(r["text"], r["toxic"]) for r in rows])
    want = {int.from_bytes(g, "big"): r for g, r in seen.items()} | {int.from_bytes(c, "big") | toxicity.CONTEXT: r for c, r in unseen.items()}
    got = {r["key"]: r["r"] for r in model.rows.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)
    plain = toxicity.Model(np.array(list(want), np.uint64), np.array(list(want.values())))
    texts = {r["doc_id"]: r["text"] for r in some.collect()}
    for r in with_toxicity(some, model).collect():  # the score of each text by the curve over its features
        x = plain.features(pa.array([texts[r["doc_id"]]]))[0]
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-(model.curve[0] + model.curve[1:] @ x))), abs=1e-4)


def test_packs_score_like_the_broadcast_model(spark, odd):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    models = [fit_toxicity(docs, labels, broadcast_grams=n) for n in (None, 0)]
    assert models[0].sent and not models[1].sent
    for table in (docs, odd):
        a, b = (sorted((str(r["doc_id"]), r["text"] or "", r["score"]) for r in with_toxicity(table, m).select("doc_id", "text", "score").collect()) for m in models)
        assert a == b and len(a) == table.count()


def test_packs_of_long_texts(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    texts = [r["text"] or "" for r in docs.orderBy("doc_id").limit(60).collect()]
    much = " ".join(texts)
    rows = [*((i, t, "e") for i, t in enumerate(texts)), *((100 + i, t, "f") for i, t in enumerate((much * (1 + (3 << 20) // len(much)), "ab" * (1 << 20), "\u00e9\u4e2d" * 500_000, much[:200_000], much[:200_000], None)))]
    table = spark.createDataFrame(rows, "id bigint, text string, kind string")
    a, b = (sorted((r["id"], r["score"], r["kind"]) for r in with_toxicity(table, fit_toxicity(docs, labels, broadcast_grams=n)).select("id", "score", "kind").collect()) for n in (None, 0))
    assert a == b and len(a) == len(rows)


def test_packs_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(toxicity, "PACK_BYTES", 1 << 14)
    monkeypatch.setattr(toxicity.tb, "SLICE_BYTES", 1 << 14)
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    model = fit_toxicity(docs, labels, broadcast_grams=0)
    seen = []
    monkeypatch.setattr(toxicity.Toxicity, "_packed", lambda self, rows, text, out, of: seen.append((rows, text)) or rows.withColumn(out, F.array().cast("array<double>")))
    model.with_features(docs)
    sizes = seen[0][0].groupBy("__pack").agg(F.sum("__size").alias("n"), F.count("*").alias("rows")).collect()
    assert max(r["n"] for r in sizes) <= 1 << 14 and max(r["rows"] for r in sizes) > 1
    assert max(r["n"] for r in seen[1][0].groupBy("__pack").agg(F.sum(F.octet_length("text")).alias("n")).collect() or [{"n": 0}]) <= 1 << 20


def test_held_out_rank(spark):
    got = queries.QUERIES["op2_toxicity"](spark, f"{DATA}/sf0.1")
    both = got.join(spark.read.parquet(f"{DATA}/sf0.1/labels.parquet"), "doc_id").where("held_out and toxic is not null").toPandas()
    rank, y = both["score"].rank(), both["toxic"] == 1
    assert (rank[y].mean() - (y.sum() + 1) / 2) / (~y).sum() >= 0.9
    assert both["predicted"][y].mean() > 0.5 and both["predicted"][~y].mean() < 0.02
