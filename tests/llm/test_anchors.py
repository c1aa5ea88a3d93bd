"""Anchors: equal windows share them, also where places wrap, and they are told apart by 64 bits."""

import numpy as np

from knnloom.llm import suffix_dedup
from knnloom.llm.suffix_dedup import ANCHOR, MATCH, snippets


def test_equal_windows_have_equal_keys_of_their_own_bytes(monkeypatch):
    rng = np.random.default_rng(4)
    shared = rng.integers(97, 123, 300).astype(np.uint8)
    data = np.concatenate([shared, rng.integers(97, 123, 900).astype(np.uint8), shared, np.full(120, 97, np.uint8)])
    off = np.array([0, 700, len(data)])
    made = []
    for place in (suffix_dedup._PLACE, np.uint64((1 << 7) - 1)):  # places of 24 bits, and of so few that they wrap
        monkeypatch.setattr(suffix_dedup, "_PLACE", place)
        key, first, last, piece = snippets(data, off)
        of = np.full(len(data), -1)
        for i, (a, b) in enumerate(zip(first, last, strict=True)):
            of[a : b + 1] = i
            windows = [data[j : j + ANCHOR].tobytes() for j in range(b, a + MATCH - ANCHOR + 1)]
            keys = suffix_dedup._keys(data, np.arange(b, a + MATCH - ANCHOR + 1)) if windows else []
            assert key[i] in keys  # the anchor lies in all windows of its run
        n = len(shared) - MATCH + 1
        assert (key[of[:n]] == key[of[1200 : 1200 + n]]).all()
        made.append(key)
    assert (made[0] >> np.uint64(40)).max() > 0 and len(np.unique(made[0])) > 20
