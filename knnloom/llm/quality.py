"""Quality classifier: histogram gradient-boosted trees over document statistics.

``document_stats`` turns each whole text into a row of numbers with numpy.
``fit_trees`` grows depth-limited trees on binned statistics by second-order
logistic boosting.  A fitted ``Trees`` holds complete binary trees flattened
into arrays, so scoring walks all rows of a batch one level at a time.

Defined cases.  A null text counts as empty; an empty text has all statistics 0
and gets the model's score for that row.  Very long texts are read whole, in
slices (see ``textbytes``); the share of distinct words is then the mean over
slices.  Repeated rows and ties score alike.  Without any labelled row of one
of the classes the score is the smoothed share of label 1 (0.5 without labels).
Columns of the input other than the text are neither read nor changed; an input
column that has the name of the output is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .labelled import fold, sample_labels

#: Labelled rows of each class that a model is fitted on, at most.
SAMPLE_ROWS = 12_000
STATS = (
    "log_bytes log_words word_bytes word_bytes_sd log_longest upper digit punctuation symbol pipe non_ascii line_rate "
    "distinct_words top_word repeated_next bare_words stop_rate comma_rate line_words repeated_lines longest_run bracket_rate"
).split()

_CLASS = np.zeros((8, 256), bool)
_CLASS[0, 65:91] = True
_CLASS[1, 48:58] = True
for _c in b".,;:!?'\"()-":
    _CLASS[2, _c] = True
for _c in b"#$%&*+/<=>@\\^_`{}~[]":
    _CLASS[3, _c] = True
_CLASS[4, ord("|")] = True
_CLASS[5, 128:] = True
_CLASS[6, ord("\n")] = True
for _c in b".!?":
    _CLASS[7, _c] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _repeats(key: np.ndarray, piece: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct keys and of the most frequent key in each piece."""
    packed = np.sort((piece.astype(np.uint64) << np.uint64(40)) | (key >> np.uint64(24)))
    first = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]]) if len(packed) else np.empty(0, np.int64)
    run = np.diff(np.r_[first, len(packed)])
    owner = (packed[first] >> np.uint64(40)).astype(np.int64)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner, run)
    return np.bincount(owner, minlength=n), top


def document_stats(col: pa.Array) -> np.ndarray:
    """One row of STATS for each text of the column."""
    n = len(col)
    add = np.zeros((n, 20))
    longest, run = np.zeros(n), np.zeros(n)
    for data, off, rows in tb.slices(col):
        if not len(data):
            continue
        m = len(rows)
        count = lambda mask: tb.segment_sum(mask.view(np.int8) if mask.dtype == bool else mask, off)
        ws, we, wp = tb.words(data, off)
        wb = np.searchsorted(wp, np.arange(m + 1))
        size = we - ws
        h = tb.span_hashes(data, ws, we)
        distinct, top = _repeats(h, wp, m)
        letters = np.r_[0, np.cumsum(_LETTER[data])]
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (wp[1:] == wp[:-1])
        ls, le = tb.spans(data != 10, off)
        lp = np.searchsorted(off, ls, "right") - 1
        lines, _ = _repeats(tb.span_hashes(data, ls, le), lp, m)
        n_lines = np.bincount(lp, minlength=m)
        turn = np.r_[True, data[1:] != data[:-1]]
        turn[off[:-1][off[:-1] < len(data)]] = True  # a run ends with its text
        change = np.flatnonzero(turn)
        same = np.diff(np.r_[change, len(data)])
        np.maximum.at(run, rows[np.searchsorted(off, change, "right") - 1], same)
        w = lambda v: tb.segment_sum(np.asarray(v, np.float64), wb)
        parts = [
            np.diff(off), np.diff(wb), w(size), w(size.astype(float) ** 2), count(_CLASS[0][data]), count(_CLASS[1][data]),
            count(_CLASS[2][data]), count(_CLASS[3][data]), count(_CLASS[4][data]), count(_CLASS[5][data]), count(_CLASS[6][data]),
            distinct, top, w(again), w(letters[we] == letters[ws]), w(_CLASS[7][data[we - 1]]), w(data[we - 1] == 44), n_lines, n_lines - lines,
            w(data[ws] == 40),
        ]
        np.add.at(add, rows, np.stack(parts, 1))
        if len(size):
            np.maximum.at(longest, rows[wp], size)
    tb.release()
    nb, nw = np.maximum(add[:, 0], 1), np.maximum(add[:, 1], 1)
    mean = add[:, 2] / nw
    cols = [
        np.log1p(add[:, 0]), np.log1p(add[:, 1]), mean, np.sqrt(np.maximum(add[:, 3] / nw - mean**2, 0)), np.log1p(longest),
        *(add[:, k] / nb for k in (4, 5, 6, 7, 8, 9, 10)), add[:, 11] / nw, add[:, 12] / nw, add[:, 13] / nw, add[:, 14] / nw, add[:, 15] / nw,
        add[:, 16] / nw, np.log1p(nw / np.maximum(add[:, 17], 1)) * (add[:, 0] > 0), add[:, 18] / np.maximum(add[:, 17], 1), np.log1p(run), add[:, 19] / nw,
    ]
    return np.stack(cols, 1)


@dataclass
class Trees:
    """Complete trees: node k of a tree has children 2k+1 and 2k+2."""

    feature: np.ndarray  # [trees, inner nodes]
    cut: np.ndarray  # [trees, inner nodes]: go right if the value is above
    leaf: np.ndarray  # [trees, leaves]
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            total += leaf[at - inner]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 64, ridge: float = 2.0, least: int = 10) -> Trees:
    """Boosted trees on histograms of at most ``bins`` quantile bins a column."""
    inner = 2**depth - 1
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    prior = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(prior / (1 - prior)))
    if not len(y) or y.min() == y.max():
        return Trees(feature[:0], cut[:0], leaf[:0], base)
    edges = [np.unique(np.quantile(c, np.arange(1, bins) / bins)) for c in x.T]
    b = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    n, width = x.shape
    flat = (b + np.arange(width) * bins).ravel()
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h, at = y - p, p * (1 - p), np.zeros(n, np.int64)
        for d in range(depth):
            k, lo = 2**d, 2**d - 1
            cell = np.repeat((at - lo) * (width * bins), width) + flat
            sums = [np.bincount(cell, np.repeat(v, width), k * width * bins).reshape(k, width, bins).cumsum(2) for v in (g, h, np.ones(n))]
            gl, hl, nl = sums
            tot = [s[:, :, -1:] for s in sums]
            gain = gl**2 / (hl + ridge) + (tot[0] - gl) ** 2 / (tot[1] - hl + ridge) - tot[0] ** 2 / (tot[1] + ridge)
            gain[(nl < least) | (tot[2] - nl < least)] = 0
            best = gain.reshape(k, -1).argmax(1)
            for node in range(k):
                f, e = divmod(int(best[node]), bins)
                if gain[node, f, e] > 1e-9 and e < len(edges[f]):
                    feature[t, lo + node], cut[t, lo + node] = f, edges[f][e]
            at = 2 * at + 1 + (x[np.arange(n), feature[t, at]] > cut[t, at])
        sums = [np.bincount(at - inner, v, inner + 1) for v in (g, h)]
        leaf[t] = rate * sums[0] / (sums[1] + ridge)
        margin += leaf[t][at - inner]
    return Trees(feature, cut, leaf, base)


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, rows: int = SAMPLE_ROWS) -> Trees:
    """Trees fitted on at most ``rows`` labelled documents of each class.

    Only the sampled ids (bounded by 2 x rows) are broadcast, and only their
    statistics come to the driver; of documents that repeat an id the smallest.
    """
    ids = sample_labels(labels, "quality", folds, held_out, rows)
    stats = F.arrow_udf(lambda text: pa.FixedSizeListArray.from_arrays(pa.array(document_stats(text).ravel()), len(STATS)).cast(pa.list_(pa.float64())), "array<double>")
    use = docs.select("doc_id", "text").join(F.broadcast(ids.withColumnRenamed("doc_id", "labelled_id")), F.col("doc_id") == F.col("labelled_id"))
    got = use.select("doc_id", "y", stats("text").alias("x")).groupBy("doc_id").agg(F.max("y").alias("y"), F.min("x").alias("x")).toArrow()
    x = np.array(got["x"].combine_chunks().flatten()).reshape(-1, len(STATS)) if got.num_rows else np.empty((0, len(STATS)))
    y, doc = got["y"].to_numpy().astype(float), got["doc_id"].to_numpy()
    order = np.lexsort((*x.T, doc))
    return fit_trees(x[order], y[order])


def with_quality(docs: DataFrame, model: Trees, score: str = "score") -> DataFrame:
    """The documents with the probability of label 1 as column ``score``."""
    udf = F.arrow_udf(lambda text: pa.array(model.score(document_stats(text))), "double")
    return docs.withColumn(score, udf(F.col("text")))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every document; see the module for the defined cases."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = with_quality(docs.select("doc_id", "text"), fit_quality(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
