"""The n-gram classifiers and their decoding, recomputed with dictionaries and loops."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from knnloom.llm import language

from ..conftest import DATA


def slots(text):
    """(size, slot) of the n-grams that end at each byte; shorter at the front of the text."""
    low = [b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in text.encode()]
    for k in range(len(low)):
        g = 0
        for n in range(4):
            if k >= n:
                g |= low[k - n] << (8 * n)
            yield n, ((g + n) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - language.BITS)


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    return language.fit_codes(docs), rows


def test_weights(model):
    got, rows = model
    counts = {}
    for i, text, lang in rows:
        if lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            counts.setdefault(lang, Counter()).update(slots(text or ""))
    langs = sorted(counts)
    assert got.langs == langs
    size = 1 << language.BITS
    total = {(x, n): sum(c for (m, _), c in counts[x].items() if m == n) + 0.5 * size for x in langs for n in range(4)}
    rate = lambda x, n, s: (counts[x][n, s] + 0.5) / total[x, n]
    rng = np.random.default_rng(0)
    for at in [*rng.integers(0, language.SLOTS, 200).tolist(), *(n * size + s for n, s in list(counts[langs[0]])[:200])]:
        n, s = divmod(at, size)
        for b in range(got.code.shape[1]):
            sides = [[rate(x, n, s) for k, x in enumerate(langs) if got.code[k, b] == side] for side in (1, -1)]
            assert got.weight[at, b] == pytest.approx(math.log(np.mean(sides[0]) / np.mean(sides[1])), abs=1e-4)


def test_decoding(model):
    got, rows = model
    texts = [t for _, t, _ in rows[:60]] + ["ok", "é", "x1"]
    best, score, unsure = got.decode(pa.array(texts))
    for text, b, p, flag in zip(texts, best, score, unsure, strict=True):
        found = list(slots(text))
        margin = [sum(float(got.weight[(n << language.BITS) + s, k]) for n, s in found) / len(text.encode()) for k in range(got.code.shape[1])]
        margin = [max(-3, min(3, m / s)) for m, s in zip(margin, got.scale, strict=True)]
        loss = [sum(t * math.exp(-m * c) for m, c, t in zip(margin, word, got.trust, strict=True)) for word in got.code]
        weight = [math.exp(-4 * (x - min(loss))) for x in loss]
        want = sorted((w / sum(weight) for w in weight), reverse=True)
        assert b == int(np.argmin(loss)) and p == pytest.approx(want[0], abs=1e-3)
        assert flag == (want[0] - want[1] < language.AMBIGUOUS) or abs(want[0] - want[1] - language.AMBIGUOUS) < 1e-3


@pytest.mark.parametrize("n", [2, 3, 5, 6, 40])
def test_codewords_are_told_apart(n):
    code = language.codewords(n)
    assert len({tuple(w) for w in code}) == n and set(np.unique(code)) == {-1, 1}
    assert all(len(set(bit)) == 2 for bit in code.T)
    least = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
    assert least >= max(1, code.shape[1] // 4)
