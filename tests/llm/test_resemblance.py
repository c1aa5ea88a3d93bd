"""Links of similarity 0.8 over five-word shingles against brute force."""

import re

import pytest
from pyspark.sql import functions as F

from knnloom.llm import resemblance
from knnloom.llm.resemblance import resembling

from ..conftest import DATA

SMALL = f"{DATA}/sf0.001"


def sets(texts):
    out = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def brute(texts, least=0.8):
    s, label = sets(texts), {i: i for i in texts}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in texts:
        for b in texts:
            if b < a and (not s[a] and not s[b] or len(s[a] & s[b]) >= least * max(1, len(s[a] | s[b]))):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: root(i) for i in texts}


def component(df):
    return {r["id"]: r["component_id"] for r in df.collect()}


@pytest.mark.parametrize("part", [256, 2])
def test_near_copies_of_one_text(spark, monkeypatch, part):
    """Copies that resemble the original or a neighbour in a chain, but mostly not each other."""
    monkeypatch.setattr(resemblance, "PART", part)
    words = [f"w{k}" for k in range(120)]
    texts = {0: " ".join(words)}
    for i in range(1, 30):  # five changed shingles each, twice: 0.84 to the original, 0.71 among copies
        texts[i] = " ".join(f"x{i}" if k in (4 * i - 1, (4 * i + 57) % 120) else w for k, w in enumerate(words))
    for i in range(30, 50):  # a chain
        words = [*words[4:], *(f"c{i}_{k}" for k in range(4))]
        texts[i] = " ".join(words)
    texts |= {50 + i: " ".join(f"z{i}_{k}" for k in range(9)) for i in range(5)} | {60: "", 61: None, 62: " \n"}
    want = brute(texts)
    assert len(set(want.values())) < 12
    assert component(resembling(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3))) == want


def test_documents(spark):
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert component(resembling(frame)) == brute({r["doc_id"]: r["text"] for r in frame.collect()})


def test_odd_rows(odd, none):
    got = resembling(odd)
    assert got.count() == odd.count() and component(got.where("id is not null"))[7] == 6
    assert resembling(none).count() == 0


def test_pipeline_stage(spark):
    """Documents 1 and 177 have a similarity of 0.83, and fingerprints nine bits apart."""
    import corpus_pipeline

    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = corpus_pipeline.near_dedup(spark, frame, SMALL)
    want = brute({r["doc_id"]: r["text"] for r in frame.collect()})
    assert sorted(r["doc_id"] for r in kept.select(F.col("doc_id")).collect()) == sorted(set(want.values()))
