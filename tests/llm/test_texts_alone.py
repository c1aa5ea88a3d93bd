"""A text's values are its own: they depend neither on the texts around it nor on how a batch is cut into slices."""

import numpy as np
import pyarrow as pa
import pytest

from knnloom.llm import language, media, quality, segmentation, toxicity
from knnloom.llm import textbytes as tb

RNG = np.random.default_rng(8)
TEXTS = [
    "ok", "a", "", None, "words aaa", "aaaaaaaaaaaa", "x", "kill", "dumb", "ok", "the same words, the same words", "ab cd", "a", "\n\n", "b\n", "\nb", "words aaa", "漢字と仮名",
    *(" ".join(RNG.choice(["red", "blue", "ok", "a", "kill", "été", "12,5", "(x)"], RNG.integers(1, 60))) for _ in range(40)),
]


def kneser_ney():
    """A model of half of the 5-grams and contexts."""
    rng = np.random.default_rng(0)
    g = np.unique(toxicity.grams(*tb.column_bytes(pa.array(TEXTS))))
    keys = np.r_[g, np.unique(g >> np.uint64(8)) | np.uint64(toxicity.CONTEXT)]
    keys = keys[rng.random(len(keys)) < 0.5]
    return toxicity.Model(keys, rng.normal(0, 2, len(keys)))


def codes():
    rng = np.random.default_rng(1)
    return language.Codes(["de", "en", "fr"], language.codewords(3), rng.normal(0, 1, (language.SLOTS, 3)).astype(np.float32), np.full(3, 1 / 3), np.ones(3))


def trees():
    rng = np.random.default_rng(2)
    return quality.fit_trees(rng.random((400, len(quality.STATS))) * 5, rng.integers(0, 2, 400).astype(float), trees=10)


OPERATORS = {
    "toxicity": lambda m=kneser_ney(): lambda col: m.features(col).tolist(),
    "language": lambda m=codes(): lambda col: list(zip(*(x.tolist() for x in m.decode(col)), strict=True)),
    "quality": lambda: lambda col: [tuple(r) for r in quality.document_stats(col).tolist()],
    "quality score": lambda m=trees(): lambda col: m.score(quality.document_stats(col)).tolist(),
    "media": lambda: lambda col: [tuple(r.values()) for r in media.stored_features(col).to_pylist()],
    "segmentation": lambda: lambda col: [[(tuple(s[0].tolist()), *s[1:]) for s in row] for row in segmentation.sample_segmentations(np.full(len(col), 5), col, samples=3)],
}


@pytest.mark.parametrize("name", OPERATORS)
def test_values_are_of_the_text_alone(name, monkeypatch):
    run, seen = OPERATORS[name](), {}
    for size in (1 << 20, 300):
        monkeypatch.setattr(segmentation, "SLICE_BYTES", size)
        cut = tb.slices
        for module in (language, toxicity, quality):
            monkeypatch.setattr(module.tb, "slices", lambda col, limit=size, whole=False, cut=cut: cut(col, max(size, 1 << 10), whole))
        for order in (np.arange(len(TEXTS)), np.arange(len(TEXTS))[::-1], np.random.default_rng(size).permutation(len(TEXTS))):
            for k, value in zip(order, run(pa.array([TEXTS[i] for i in order], pa.string())), strict=True):
                assert seen.setdefault(TEXTS[k], value) == value, TEXTS[k]
        monkeypatch.undo()
    assert seen[""] == seen[None]


def test_runs_end_with_their_text():
    stats = quality.document_stats(pa.array(["words aaa", "aaaaaaaaaaaa", "words aaa"]))
    assert np.expm1(stats[:, quality.STATS.index("log_run" if "log_run" in quality.STATS else "longest_run")]).round().tolist() == [3, 12, 3]


@pytest.mark.parametrize("size", [5000, 20_000])
def test_long_words_are_told_apart(size):
    """Unspaced runs whose blocks of 4096 bytes are exchanged."""
    a, b = ("".join(np.random.default_rng(s).choice(list("abcdefghij漢字"), 4096)) for s in (1, 2))
    a, b = (x.encode()[:4096].decode("utf-8", "ignore").ljust(4096, "q")[:4096] for x in (a, b))
    blocks = [x.encode().ljust(4096, b"z")[:4096].decode("utf-8", "ignore") for x in (a, b)]
    texts = ["x" * 4095 + blocks[0] + blocks[1] + "tail" * size, "x" * 4095 + blocks[1] + blocks[0] + "tail" * size, "x" * size]
    for text, samples in zip(texts, segmentation.sample_segmentations(np.arange(3), pa.array(texts)), strict=True):
        assert all(segmentation.decode(s[0]) == text.encode() for s in samples)


def test_words_of_equal_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(tb, "_BYTE_HASH", np.ones(256, np.uint64))
    monkeypatch.setattr(tb, "_POW", np.ones(4096, np.uint64))
    data = np.frombuffer(b"abcdababba", np.uint8)
    one, same = tb.distinct_words(data, np.arange(0, 10, 2))
    words = [bytes(data[i : i + 2]) for i in range(0, 10, 2)]
    assert [words[one[k]] for k in same] == words and len(one) == 3


def test_hashes_of_long_spans():
    a, b = (np.random.default_rng(s).integers(97, 123, 4096).astype(np.uint8) for s in (3, 4))
    data = np.concatenate([a, b, b, a])
    h = tb.span_hashes(data, np.array([0, 8192]), np.array([8192, 16384]))
    assert h[0] != h[1]
    again = tb.span_hashes(np.concatenate([a, b, a, b]), np.array([0, 8192]), np.array([8192, 16384]))
    assert again[0] == again[1]
