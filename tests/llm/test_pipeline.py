"""Each stage of the pipeline against brute force on what it reads."""

import zlib

import corpus_pipeline as p
import numpy as np
import pytest
from pyspark.sql import functions as F

from knnloom.llm import quality, queries, segmentation
from knnloom.llm.labelled import fold

from ..conftest import DATA
from .test_resemblance import brute

SMALL = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def seen(spark, tmp_path_factory):
    """What each stage reads and returns."""
    path, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    for name, stage in p.STAGES:
        stage(spark, docs, SMALL).write.parquet(str(path / name))
        out[name] = (docs, spark.read.parquet(str(path / name)))
        docs = out[name][1]
    return out


def table(df):
    return df.orderBy("doc_id").toPandas()


def walked(model, x):
    """Scores of rows by walking each tree for each row."""
    out = []
    for row in x:
        total = model.base
        for f, c, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if row[f[at]] > c[at] else 1)
            total += leaf[at - len(f)]
        out.append(1 / (1 + np.exp(-total)))
    return out


def test_quality(spark, seen):
    import pyarrow as pa

    before, after = (table(df) for df in seen["quality"])
    model = quality.fit_quality(seen["quality"][0], spark.read.parquet(f"{SMALL}/labels.parquet"))
    score = walked(model, quality.document_stats(pa.array(before["text"])))
    assert after["doc_id"].tolist() == [i for i, s in zip(before["doc_id"], score, strict=True) if s >= p.KEEP_FROM]
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").where("quality is not null")
    both = labels.withColumn("held_out", fold(F.col("doc_id"), 5) == 0).toPandas()
    good = set(both["doc_id"][(both["quality"] == 1) & both["held_out"]])
    assert len(good & set(after["doc_id"])) > 0.9 * len(good & set(before["doc_id"]))


def test_near_dedup(seen):
    before, after = (table(df) for df in seen["near_dedup"])
    component = brute(dict(zip(before["doc_id"], before["text"], strict=True)))
    assert sorted(after["doc_id"]) == sorted(set(component.values()))


def test_repeat_dedup(seen):
    before, after = (table(df) for df in seen["repeat_dedup"])
    first, want = {}, {}
    texts = [(int(i), t.encode()) for i, t in zip(before["doc_id"], before["text"], strict=True)]
    for i, b in texts:
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(i, first.get(b[k : k + 50], i))
    for i, b in texts:
        hit = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                hit[k : k + 50] = True
        left = np.frombuffer(b, np.uint8)[~hit].tobytes().decode("utf-8", "ignore")
        if not hit.any() or left.strip(" "):
            want[i] = left
    assert dict(zip(after["doc_id"], after["text"], strict=True)) == want
    assert any(len(t) < len(b.decode()) for (i, b), t in ((x, want.get(x[0], "")) for x in texts))
    assert all(n == len(t) for n, t in zip(after["n_chars"], after["text"], strict=True))


def test_mixing(seen, duck):
    before, after = (table(df) for df in seen["mixing"])
    duck.register("mixed_from", before)
    want = duck.execute(queries.ORACLE_SQL["op8_mixing"].replace("FROM documents", "FROM mixed_from")).df()
    text = dict(zip(before["doc_id"], before["text"], strict=True))
    got = {}
    for i, t in zip(after["doc_id"], after["text"], strict=True):
        words = t.split()
        assert t == text[i] or words == text[i].split()[: len(words)]
        got[i] = got.get(i, 0) + len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t)])
    assert got == {i: n for i, n in zip(want["doc_id"], want["taken"], strict=True) if n}


def test_segmentation(seen):
    before, after = seen["segmentation"]
    texts = sorted((r["doc_id"], zlib.crc32((r["text"] or "").encode())) for r in before.collect())
    rows = after.collect()
    assert sorted((r["doc_id"], r["segmentations"][0]["decoded_crc32"]) for r in rows) == texts
    for r in rows:
        crc = {zlib.crc32(segmentation.decode(np.array(s["ids"]))) if s["ids"] else 0 for s in r["segmentations"]}
        assert crc == {s["decoded_crc32"] for s in r["segmentations"]} and len(crc) == 1
        assert len({tuple(s["ids"]) for s in r["segmentations"]}) == len(r["segmentations"])
    copies = {}
    for r in rows:
        copies.setdefault((r["doc_id"], r["segmentations"][0]["decoded_crc32"], len(r["segmentations"][0]["ids"]) > 50), []).append(tuple(r["segmentations"][0]["ids"]))
    again = [c for (_, _, long), c in copies.items() if long and len(c) > 1]
    assert again and all(len(set(c)) == len(c) for c in again)


def test_whole_run(spark, seen):
    got = p.run(spark, SMALL)
    assert got.count() == seen["segmentation"][1].count()
    assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == sorted(r["doc_id"] for r in seen["segmentation"][1].select("doc_id").collect())


def test_first_split_is_the_best_of_all():
    """A tree's first cut has the largest gain among all cuts between values."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (300, 5)).astype(float)
    y = ((x[:, 2] > 6) ^ (rng.random(300) < 0.1)).astype(float)
    model = quality.fit_trees(x, y, trees=1, depth=1, bins=64)
    prior = (y.sum() + 1) / (len(y) + 2)
    g, h = y - prior, np.full(len(y), prior * (1 - prior))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 2.0)
    best = max(((gain(x[:, f] <= c) + gain(x[:, f] > c), f, c) for f in range(5) for c in np.unique(x[:, f])[:-1] if 10 <= (x[:, f] <= c).sum() <= 290), key=lambda t: t[0])
    assert (model.feature[0, 0], model.cut[0, 0]) == best[1:]
    right = x[:, best[1]] > best[2]
    for k, m in enumerate((~right, right)):
        assert model.leaf[0, k] == pytest.approx(0.12 * g[m].sum() / (h[m].sum() + 2.0))
    assert model.score(x).tolist() == pytest.approx(walked(model, x))
