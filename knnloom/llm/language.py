"""Language identification by error-correcting output codes.

Each learned language has a codeword.  For each bit a binary classifier over
hashed byte n-grams (log-odds of the languages whose bit is set against the
others, from smoothed counts) predicts the bit from the mean log-odds of the
text's n-grams.  Decoding weighs the exponential loss of each bit by how well
that bit separated the languages in training, takes the nearest codeword, and
flags a text as ambiguous if the second is close.

Counts come from all rows of the learning folds and are summed on the cluster;
languages x SLOTS of them (a fixed number for each language) come to the driver.

Defined cases.  A null text or one without any letter is ``und`` with score 0,
as is every text if no language was learned; a single learned language gets
score 1.  Rows whose lang or id is null don't teach (a null id is in the fold
of the empty text).  Repeated rows teach each time.  Ties go to the language
first by code point.  Very long texts are read whole in slices.  Other columns
are neither read nor changed; input columns with the outputs' names are replaced.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .labelled import fold

SIZES = (1, 2, 3, 4)
BITS = 13
SLOTS = len(SIZES) << BITS
#: Two codewords are told apart if their decoding probabilities differ by this.
AMBIGUOUS = 0.2
_PLAIN = tb._LOWER.copy()
_PLAIN[:128][~np.isin(np.arange(128), [*range(97, 123), *range(65, 91)])] = 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """[n, bits] of -1 and 1: exhaustive up to five classes, else random columns of 10 log2 n."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 5:
        return np.array([[1, *c] for c in itertools.product((1, -1), repeat=n - 1)][1:]).T
    rng, want = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, gap = None, -1
    for _ in range(50):
        code = np.stack([rng.permutation(np.where(np.arange(n) < n // 2, 1, -1)) for _ in range(want)], 1)
        least = min(int((code[i] != code[j]).sum()) for i, j in itertools.combinations(range(n), 2)) if n <= 200 else 0
        if least > gap:
            best, gap = code, least
    return best


def gram_slots(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """For each size the slot of the n-gram that ends at each byte (short at the front of each piece)."""
    place = np.arange(len(data)) - np.repeat(off[:-1], np.diff(off))
    low = _PLAIN[data].astype(np.uint32)
    g, out = np.zeros(len(low), np.uint32), []
    for k in range(max(SIZES)):
        g[k:] |= np.where(place[k:] >= k, low[: len(low) - k] << np.uint32(8 * k), np.uint32(0))
        if k + 1 in SIZES:
            h = ((g + np.uint32(k)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
            out.append(h.astype(np.int64) + (SIZES.index(k + 1) << BITS))
    return out


def has_letter(col: pa.Array) -> np.ndarray:
    """Whether each text holds a letter of any script."""
    out, rare = np.zeros(len(col), bool), np.zeros(len(col), bool)
    for data, off, rows in tb.slices(col):
        np.logical_or.at(out, rows, tb.segment_sum(_ASCII_LETTER[data].view(np.int8), off) > 0)
        np.logical_or.at(rare, rows, tb.segment_sum((data > 127).view(np.int8), off) > 0)
    for i in np.flatnonzero(rare & ~out):
        out[i] = any(c.isalpha() for c in col[i].as_py())
    return out


def count_slots(batches):
    """(lang, slot, n) sums of batches of (text, lang), once for each partition."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        lang = np.array(batch.column(1).to_pylist(), object)
        for data, off, rows in tb.slices(batch.column(0)):
            slots = gram_slots(data, off)
            for name in set(lang[rows]):
                use = np.repeat(lang[rows] == name, np.diff(off))
                total = sums.setdefault(name, np.zeros(SLOTS, np.int64))
                for s in slots:
                    total += np.bincount(s[use], minlength=SLOTS)
    for name, total in sums.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(total[at])], ["lang", "slot", "n"])


@dataclass
class Codes:
    langs: list[str]
    code: np.ndarray  # [langs, bits]
    weight: np.ndarray  # [SLOTS, bits] log-odds
    trust: np.ndarray  # [bits]
    scale: np.ndarray  # [bits]

    def margins(self, col: pa.Array) -> np.ndarray:
        total, n = np.zeros((len(col), self.code.shape[1])), np.zeros(len(col))
        for data, off, rows in tb.slices(col, 1 << 18):
            if len(data):
                slots = gram_slots(data, off)
                w = self.weight[slots[0]]
                for s in slots[1:]:
                    w += self.weight[s]
                np.add.at(total, rows, tb.segment_sum(w, off))
                np.add.at(n, rows, np.diff(off))
        return total / np.maximum(n, 1)[:, None]

    def decode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language or -1, score, ambiguous)"""
        ok = has_letter(col)
        if not self.langs:
            ok[:] = False
        if len(self.langs) < 2:
            return np.where(ok, 0, -1), ok.astype(float), ~ok
        m = np.clip(self.margins(col) / self.scale, -3, 3)
        wrong, right = np.exp(m) * self.trust, np.exp(-m) * self.trust  # the loss of a bit that is -1, or 1
        loss = np.stack([np.where(word > 0, right, wrong).sum(1) for word in self.code], 1)
        p = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best, two = p.argmax(1), np.sort(p, 1)[:, -2:]
        return np.where(ok, best, -1), np.where(ok, p.max(1), 0.0), ~ok | (two[:, 1] - two[:, 0] < AMBIGUOUS)


def fit_codes(docs: DataFrame, folds: int = 4, held_out: int = 2) -> Codes:
    """A model of the documents' ``lang``, learned outside the held-out fold."""
    use = docs.where(F.col("lang").isNotNull() & (fold(F.col("doc_id"), folds) != held_out)).select("text", "lang")
    got = use.mapInArrow(count_slots, "lang string, slot bigint, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    counts = np.zeros((len(langs), SLOTS))
    counts[[langs.index(x) for x in got["lang"]], got["slot"]] = got["n"]
    code = codewords(len(langs))
    block = counts.reshape(len(langs), len(SIZES), 1 << BITS)
    rate = ((block + 0.5) / (block + 0.5).sum(2, keepdims=True)).reshape(counts.shape)  # each language counts alike
    bits = code.shape[1]
    weight = np.zeros((SLOTS, bits), np.float32)
    for b in range(bits):
        weight[:, b] = np.log(rate[code[:, b] > 0].mean(0) / rate[code[:, b] < 0].mean(0))
    mean = rate @ weight  # of each language's own n-grams
    gap = np.array([(mean[:, b] * code[:, b]).min() for b in range(bits)]) if bits else np.empty(0)
    trust = np.maximum(gap, 1e-3) / np.maximum(gap, 1e-3).sum() if bits else gap
    return Codes(langs, code, weight, trust, np.maximum(np.abs(mean).mean(0), 1e-6) if bits else gap)


def with_language(docs: DataFrame, model: Codes, lang: str = "lang_pred", score: str = "score", ambiguous: str = "ambiguous") -> DataFrame:
    """The documents with predicted language, its probability and the ambiguity flag."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [*model.langs, "und"]

    def predict(text: pa.Array) -> pa.Array:
        best, p, unsure = sent.value.decode(text)
        return pa.StructArray.from_arrays([pa.array([names[i] for i in best], pa.string()), pa.array(p, pa.float64()), pa.array(unsure)], ["lang", "score", "ambiguous"])

    udf = F.arrow_udf(predict, "lang string, score double, ambiguous boolean")
    found = docs.withColumn("__language", udf(F.col("text")))
    return found.withColumns({lang: F.col("__language.lang"), score: F.col("__language.score"), ambiguous: F.col("__language.ambiguous")}).drop("__language")


def op7_language(spark, sf_dir: str) -> DataFrame:
    """Language of every document; see the module for the defined cases."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = with_language(docs.select("doc_id", "text"), fit_codes(docs))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
