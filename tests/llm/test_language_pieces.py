"""A text's n-grams are its own, wherever it stands in a batch."""

import numpy as np
import pyarrow as pa

from knnloom.llm import language
from knnloom.llm import textbytes as tb


def test_slots_stop_at_texts():
    texts = ["x", "abcdef", "", "x", "é", "ab", "x"]
    data, off = tb.column_bytes(pa.array(texts))
    got = language.gram_slots(data, off)
    for k, text in enumerate(texts):
        alone = language.gram_slots(*tb.column_bytes(pa.array([text])))
        assert all(np.array_equal(g[off[k] : off[k + 1]], a) for g, a in zip(got, alone, strict=True))
