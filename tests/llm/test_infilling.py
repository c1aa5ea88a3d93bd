"""Fill-in-middle against regular expressions, round trips and odd texts."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from knnloom.llm import infilling, queries

from ..conftest import DATA

TOKENS = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def plain(text, key, plain_share=10, spm_share=20):
    """(n, form, output, prefix, middle) with lists of tokens."""
    text, tokens = text or "", TOKENS.findall(text or "")
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    a, b, c, d = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= 100 - plain_share:
        return n, "plain", text, None, None
    i, j = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = ("".join(tokens[x:y]) for x, y in ((0, i), (i, j), (j, n)))
    return (n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)) if d % 100 < spm_share else (n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m))


def test_select_by_halves():
    rng = np.random.default_rng(1)
    for width in (1, 2, 3, 63, 64, 1000):
        for share in (0.0, 0.1, 0.9, 1.0):
            bits = rng.random(width) < share
            mask = int("".join("1" if b else "0" for b in bits[::-1]) or "0", 2)
            at = np.flatnonzero(bits).tolist()
            assert [infilling.select(mask, r, width) for r in range(len(at) + 2)] == [*at, width, width]


@pytest.mark.parametrize("text", ["", "a", "ab cd", " x", "naïve café — ßa", "漢字a\U0001f600b", "\r\n\t..", "a" * 9000, "é" * 5000 + "z", "<P", "<<S>", "x̀y"])
def test_starts_and_points(text):
    starts, points = infilling.masks(text.encode())
    found = [m.start() for m in TOKENS.finditer(text)]
    offsets = np.r_[0, np.cumsum([len(c.encode()) for c in text])].astype(int)
    assert [i for i in range(len(text.encode())) if starts >> i & 1] == [offsets[i] for i in found]
    assert points.bit_count() == len(text)


def test_query_against_tokens(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = queries.QUERIES["op12_infilling"](spark, f"{DATA}/sf0.001").collect()
    assert len(got) == len(texts)
    for r in got:
        n, form, output, p, m = plain(texts[r["doc_id"]], r["doc_id"])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, p, m)
        assert r["output_sha256"] == sha(output) and r["restored_sha256"] == sha(texts[r["doc_id"]] or "")


@pytest.mark.parametrize("shares", [(0, 0), (0, 100), (100, 0)])
def test_odd_texts_come_back(spark, odd, none, shares):
    more = [(100 + i, t) for i, t in enumerate(["<P>", "a<S>b", "<M", "<", "<<", "S><P", "x<", "\u0000a\u0000", "a" * 300_000 + " b", "é " * 100_000, "\n", "<P>" * 3, "P><S"] * 4)]
    rows = odd.select("doc_id", "text", "score").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"), allowMissingColumns=True).withColumn("n", F.lit(1)).withColumn("fim", F.lit("x"))
    made = infilling.with_infilling(rows, plain=shares[0], suffix_first=shares[1])
    assert made.columns == ["doc_id", "text", "score", "n", "fim"]
    for r in made.withColumn("back", infilling.restored(F.col("fim.output"), F.col("fim.form"))).collect():
        assert tuple(r["fim"]) == plain(r["text"], r["doc_id"], *shares)
        assert r["back"] == (r["text"] or "")
    assert infilling.with_infilling(none).count() == 0
