"""SentencePiece encoding and decoding: distinct sampled segmentations of a text.

A text is cut where no piece of the vocabulary can cross (before runs of spaces
and around line breaks); the words in between get a lattice of all pieces that
match, with byte pieces for characters that are no piece.  A segmentation's
weight falls with the ranks of its pieces, to the power ``alpha``.  Backward
sums over the lattice make the weights a distribution over segmentations of the
whole text, exactly.

Sampling without replacement is a perturbed A* search from the root.  Every set
of segmentations that has not been told apart yet (those that follow a sampled
one up to some piece and then leave it) carries the largest Gumbel-perturbed
log-probability of its members, drawn below that of the set it came from.  The
set with the largest value is opened: its best member is completed by sampling
down the lattice, and what it leaves behind are new sets.  So segmentations come
out by falling perturbed value, which is Gumbel top-k.  The next value that
would have come is the threshold kappa, and a segmentation of probability p was
included with chance 1 - exp(-exp(log p - kappa)).

All draws are hashes of (seed, row key, sample, place), so a row's samples
depend on nothing else.  A word's lattice is built once and kept for later slices,
up to WORD_BYTES of words, and all texts of a slice are searched in step, in numpy.

Defined cases.  A null or empty text has one segmentation, without pieces, of
inclusion 1.  A text with fewer segmentations than asked for gets all of them,
with inclusion 1.  A null key draws like key 0, one that isn't an integer by its hash;
equal keys and texts give equal samples.  Very long texts are searched whole.  Other columns are neither read
nor changed; input columns with the outputs' names are replaced.
"""

from __future__ import annotations

import itertools
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from . import textbytes as tb

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
ALPHA = 1.5
SEED = 17
#: Bytes of text that are searched together; bounds a worker's memory.
SLICE_BYTES = 1 << 18
#: Bytes of words whose lattices are kept from slice to slice (about 110 bytes each).
WORD_BYTES = 1 << 20
_GOLD = 0x9E3779B97F4A7C15
_BASE = np.uint64(0x100000001B3)


class Vocabulary:
    """Pieces by hash of their bytes, with log-weights by rank."""

    def __init__(self, path: str, alpha: float) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.text = [b""] * n
        self.byte_id = np.zeros(256, np.int64)
        plain = []
        for i in range(n):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[3:5], 16)
                self.text[i], self.byte_id[b] = bytes([b]), i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.text[i] = sp.id_to_piece(i).replace("▁", " ").encode()
                plain.append(i)
        self.space = any(t.rstrip(b" ").find(b" ", len(t) - len(t.lstrip(b" "))) >= 0 for t in (self.text[i] for i in plain))
        if self.space:
            raise ValueError("a piece crosses a space; words can't be segmented alone")
        self.split_lines = all(t == b"\n" or b"\n" not in t for t in (self.text[i] for i in plain))
        rank = np.array([-sp.get_score(i) for i in range(n)])
        order = np.empty(n)
        order[np.argsort(rank, kind="stable")] = np.arange(n)
        order[[i for i in range(n) if sp.is_byte(i)]] = n
        self.weight = -alpha * np.log(2.0 + order)
        self.longest = max(len(self.text[i]) for i in plain)
        self.bits = 18
        self.keys, self.ids = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int64)
        fronts: dict[int, int] = {}  # hash of each front of a piece: the piece, or -2 if it is none
        for i in plain:
            h = 0
            for b in self.text[i]:
                h = (h * int(_BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
                fronts.setdefault(h, -2)
            fronts[h] = i
        for h, i in fronts.items():
            at = (h * _GOLD & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
            while self.keys[at]:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.ids[at] = h, i
        byte = np.arange(256, dtype=np.uint64) + np.uint64(1)
        self.one, self.two = self.find(byte), self.find((byte[:, None] * _BASE + byte).ravel())  # by the first bytes themselves
        size = np.array([len(t) for t in self.text])
        self.size, self.start, self.blob = size, np.cumsum(size) - size, np.frombuffer(b"".join(self.text), np.uint8)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, -2 for the front of a longer piece, or -1."""
        at = ((h * np.uint64(_GOLD)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(h), -1)
        left = np.arange(len(h))
        while len(left):
            k = self.keys[at[left]]
            hit = k == h[left]
            out[left[hit]] = self.ids[at[left[hit]]]
            left = left[~hit & (k != 0)]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a run of pieces."""
        size = self.size[ids]
        return self.blob[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[ids], size)]


@lru_cache(maxsize=2)
def vocabulary(path: str = MODEL, alpha: float = ALPHA) -> Vocabulary:
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return Vocabulary(path, alpha)


class Lattice:
    """The lattices of words, end to end: nodes are bytes, each word has an end node.

    Words are told apart by their bytes.  Lattices are kept from one slice of texts
    to the next until they hold more than ``limit`` bytes of words.
    """

    EDGES = (("dst", np.int32), ("ids", np.int32), ("logp", np.float64), ("upto", np.float64))

    def __init__(self, vocab: Vocabulary, limit: int = 0) -> None:
        self.vocab, self.limit = vocab, limit
        self.start: dict[bytes, int] = {}  # first node of each word
        self.nodes = self.edges = 0
        self.first = np.zeros(1, np.int64)
        for name, kind in self.EDGES:
            setattr(self, name, np.empty(0, kind))

    def starts(self, data: np.ndarray, ws: np.ndarray) -> np.ndarray:
        """The first node of each word of data, cut at ws; words that are new get their lattices."""
        if self.nodes > self.limit:  # the room of the arrays is used again
            self.start = {}
            self.nodes = self.edges = 0
        one, same = tb.distinct_words(data, ws)
        text, we = data.tobytes(), np.r_[ws[1:], len(data)]
        spans = [text[a:b] for a, b in zip(ws[one].tolist(), we[one].tolist(), strict=True)]
        at = list(map(self.start.get, spans))
        new = [w for w, k in zip(spans, at, strict=True) if k is None]
        if new:
            size = np.fromiter(map(len, new), np.int64, len(new))
            first = (self.nodes + np.cumsum(size) - size).tolist()
            self._add(np.frombuffer(b"".join(new), np.uint8), size)
            self.start.update(zip(new, first, strict=True))
            rest = iter(first)
            at = [next(rest) if k is None else k for k in at]
        return np.array(at, np.int64)[same]

    def _append(self, name: str, used: int, values: np.ndarray) -> None:
        held = getattr(self, name)
        if used + len(values) > len(held):
            more = np.empty(max(used + len(values), used + used // 2), held.dtype)
            more[:used] = held[:used]
            setattr(self, name, more)
        getattr(self, name)[used : used + len(values)] = values

    def _add(self, data: np.ndarray, size: np.ndarray) -> None:
        vocab, n = self.vocab, len(data)
        stop = np.repeat(np.cumsum(size), size)
        left = stop - np.arange(n)
        lead = (data & 0xC0) != 0x80
        head = np.maximum.accumulate(np.where(lead, np.arange(n), 0))
        width = np.bincount(head, minlength=n)  # bytes of the character that starts here
        single, count = np.zeros(n, bool), np.zeros(n, np.int64)
        found = []  # (source, length, piece, place among the edges of the source)
        live = np.arange(n)
        for ell in range(1, vocab.longest + 1):
            live = live[left[live] >= ell] if ell > 1 else live
            if not len(live):
                break
            if ell == 1:
                h, got = data + np.uint64(1), vocab.one[data]
            elif ell == 2:
                pair = data[live].astype(np.int64) << 8 | data[live + 1]
                h[live], got = h[live] * _BASE + (data[live + 1] + np.uint64(1)), vocab.two[pair]
            else:
                h[live] = now = h[live] * _BASE + (data[live + ell - 1] + np.uint64(1))
                got = vocab.find(now)
            hit = got >= 0
            at = live[hit]
            found.append((at.astype(np.int32), ell, got[hit].astype(np.int32), count[at].astype(np.int32)))
            count[at] += 1
            single[at[width[at] == ell]] = True
            live = live[got != -1]  # what no piece begins with, no longer piece does
        bare = np.flatnonzero(~single[head])
        found.append((bare, 1, vocab.byte_id[data[bare]], count[bare]))
        count[bare] += 1
        first = np.r_[0, np.cumsum(count)]
        m = int(first[-1])
        src, dst, ids = np.repeat(np.arange(n, dtype=np.int32), count), np.empty(m, np.int32), np.empty(m, np.int32)
        while found:  # the longest piece first: it is the likeliest
            at, ell, piece, place = found.pop()
            k = first[at + 1] - 1 - place
            dst[k], ids[k] = at + ell, piece
        del h, live
        score = vocab.weight[ids]
        last = dst == stop[src]
        beta = np.zeros(n + 1)
        # from the ends of the words to their fronts: nodes by their distance from the end
        order = np.argsort(left.astype(np.uint16) if left.max() < 1 << 16 else left, kind="stable")
        cuts = np.r_[0, np.cumsum(np.bincount(left))]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            node = order[a:b]
            node = node[count[node] > 0]  # the others lie within a character
            if not len(node):
                continue
            many = count[node]
            start = np.cumsum(many) - many
            k = np.arange(int(start[-1] + many[-1])) + np.repeat(first[node] - start, many)
            s = score[k] + beta[dst[k]] * ~last[k]
            top = np.maximum.reduceat(s, start)
            beta[node] = np.log(np.add.reduceat(np.exp(s - np.repeat(top, many)), start)) + top
            score[k] = s
        logp = score - beta[src]
        p = np.exp(logp)
        upto = p.copy()  # cumulative probability within the source, each source by itself
        at, rest = first[:-1], count
        for _ in range(1, int(count.max())):
            more = rest > 1
            at, rest = at[more] + 1, rest[more] - 1
            upto[at] += upto[at - 1]
        upto[first[1:] - 1] = 2.0
        dst += np.int32(self.nodes)
        dst[last] = -1
        self._append("first", self.nodes, first + self.edges)
        for name, values in zip((e[0] for e in self.EDGES), (dst, ids, logp, upto), strict=True):
            self._append(name, self.edges, values)
        self.nodes += n
        self.edges += m

    def source(self, edge: int) -> int:
        """The node that an edge starts from."""
        return int(np.searchsorted(self.first[: self.nodes + 1], edge, "right")) - 1

    def step(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge that a uniform number picks at each node."""
        e = self.first[node]
        on = np.flatnonzero(u > self.upto[e])
        while len(on):
            e[on] += 1
            on = on[u[on] > self.upto[e[on]]]
        return e


def _uniform(key: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashes."""
    return ((tb.mix64(key) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def _cut_words(data: np.ndarray, off: np.ndarray, lines: bool) -> np.ndarray:
    """Starts of the words: before a run of spaces, around line breaks, at a piece's front."""
    space = data == 32
    cut = np.zeros(len(data), bool)
    cut[1:] = space[1:] & ~space[:-1]
    if lines:
        line = data == 10
        cut |= line
        cut[1:] |= line[:-1]
    cut[off[:-1][off[:-1] < off[1:]]] = True
    return np.flatnonzero(cut)


class Search:
    """Samples of the texts of one slice; a path is an array of edges for each text."""

    def __init__(self, lattice: Lattice, data: np.ndarray, off: np.ndarray, keys: np.ndarray, samples: int, seed: int) -> None:
        self.lattice, self.docs, self.samples = lattice, len(off) - 1, samples
        self.seed = tb.mix64(keys.astype(np.int64).view(np.uint64) + np.uint64((seed * _GOLD) & 0xFFFFFFFFFFFFFFFF))
        ws = _cut_words(data, off, lattice.vocab.split_lines)
        self.doc = np.searchsorted(off, ws, "right") - 1
        self.word_first = np.searchsorted(self.doc, np.arange(self.docs + 1))
        self.start = lattice.starts(data, ws)

    def complete(self, sample: int, doc: np.ndarray, place: np.ndarray, node: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Samples words to their ends; returns edges in order of (word, step), with the word's row."""
        rows, edges, which, steps = np.arange(len(doc)), [], [], []
        step = step.copy()
        salt = np.uint64(((sample + 1) * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
        base = self.seed[doc] + salt + (place.astype(np.uint64) << np.uint64(24))
        while len(rows):
            e = self.lattice.step(node, _uniform(base[rows] + step.astype(np.uint64)))
            edges.append(e)
            which.append(rows)
            steps.append(step)
            node = self.lattice.dst[e]
            on = node >= 0
            rows, node, step = rows[on], node[on], step[on] + 1
        if not edges:
            return (np.empty(0, np.int64),) * 3
        edges, which, steps = map(np.concatenate, (edges, which, steps))
        order = tb.stable_order(which)  # a word's steps come one after another already
        return edges[order], which[order], steps[order]

    def run(self) -> list[list[tuple]]:
        """For each text the samples (edges, log-probability, value), best first; sets self.kappa."""
        lat = self.lattice
        n = self.docs
        place = np.arange(len(self.doc)) - self.word_first[self.doc]
        edges, which, steps = self.complete(0, self.doc, place, self.start, np.zeros(len(self.doc), np.int64))
        bounds = np.searchsorted(self.doc[which], np.arange(n + 1))
        top = -np.log(-np.log(_uniform(self.seed ^ np.uint64(0xA5A5A5A5))))
        # open sets of each text: arrays over the steps of a path after its branch
        paths = [dict(edges=edges, word=which, step=steps, bounds=bounds, base=np.zeros(n), top=top, shared=np.zeros(n, np.int64))]
        found: list[list[tuple]] = [[] for _ in range(n)]
        self._value(paths[0], 0)
        for d in range(n):
            a, b = bounds[d], bounds[d + 1]
            found[d].append((edges[a:b], float(lat.logp[edges[a:b]].sum()), float(top[d])))
        taken: dict[tuple[int, int, int], list[int]] = {}
        self.kappa = np.full(n, -np.inf)
        for j in range(1, self.samples + 1):
            best, value = np.full(n, -1), np.full(n, -np.inf)
            for q, p in enumerate(paths):
                better = p["best"] > value
                best[better], value[better] = q, p["best"][better]
            if j == self.samples:
                self.kappa = value
                break
            self._branch(j, paths, best, value, found, taken)
        return found

    def _value(self, p: dict, sample: int) -> None:
        """Perturbed values of the sets that leave a path at each of its steps, and the best of each text."""
        lat, n = self.lattice, self.docs
        lp = lat.logp[p["edges"]]
        doc = np.repeat(np.arange(n), np.diff(p["bounds"]))
        prefix = np.empty(len(lp))  # each text's sums are its own, to the last digit
        for a, b in itertools.pairwise(p["bounds"].tolist()):
            np.cumsum(lp[a:b], out=prefix[a:b])
        prefix += p["base"][doc] - lp
        with np.errstate(divide="ignore"):  # the only edge of a node has log-probability 0, so nothing leaves it
            rest = np.log(np.maximum(-np.expm1(lp), 0))
        mass = prefix + rest
        e = -np.log(_uniform(self.seed[doc] + np.uint64(((sample + 101) * 0x8CB92BA72F3D8DD7) & 0xFFFFFFFFFFFFFFFF) + (np.arange(len(doc)) - p["bounds"][:-1][doc]).astype(np.uint64)))
        p["prefix"], p["mass"] = prefix, mass
        p["value"] = -np.logaddexp(-p["top"][doc], np.log(e) - mass)
        self._best(p)

    def _best(self, p: dict) -> None:
        b = p["bounds"]
        p["best"] = np.full(self.docs, -np.inf)
        full = np.flatnonzero(b[1:] > b[:-1])
        if len(full):
            p["best"][full] = np.maximum.reduceat(p["value"], b[full])

    def _branch(self, j: int, paths: list[dict], best: np.ndarray, value: np.ndarray, found: list, taken: dict) -> None:
        """Opens each text's best set: another edge at its step, then down the lattice."""
        lat, n = self.lattice, self.docs
        live = np.flatnonzero(value > -np.inf)
        heads: dict[int, np.ndarray] = {}
        base, shared, edge_of = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        word_at, step_at = np.zeros(n, np.int64), np.zeros(n, np.int64)
        u = _uniform(self.seed ^ np.uint64((j * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF))
        again = np.log(-np.log(_uniform(self.seed ^ np.uint64((j * 0x165667B19E3779F9) & 0xFFFFFFFFFFFFFFFF))))
        for d, q in zip(live.tolist(), best[live].tolist(), strict=True):
            p = paths[q]
            a, b = p["bounds"][d], p["bounds"][d + 1]
            t = int(a + p["value"][a:b].argmax())
            e = int(p["edges"][t])
            s = lat.source(e)
            x, z = int(lat.first[s]), int(lat.first[s + 1])
            w = np.exp(lat.logp[x:z])
            out = taken.setdefault((q, d, t), [e])
            w[[o - x for o in out]] = 0
            run = w.cumsum()
            new = int(run.searchsorted(u[d] * run[-1]))
            if new >= z - x or w[new] == 0:
                new = int(np.flatnonzero(w)[-1])
            out.append(x + new)
            w[new] = 0  # the set without what was taken
            left = w.sum()
            p["mass"][t] = p["prefix"][t] + np.log(left) if left > 0 else -np.inf
            p["value"][t] = -np.logaddexp(-value[d], again[d] - p["mass"][t]) if left > 0 else -np.inf
            heads[d] = np.concatenate((found[d][q][0][: int(p["shared"][d]) + t - a], [x + new]))
            base[d], shared[d], edge_of[d] = p["prefix"][t] + lat.logp[x + new], len(heads[d]), x + new
            word_at[d], step_at[d] = p["word"][t], p["step"][t]
        for p in paths:
            self._best(p)
        # the rest of the branching word, then all later words of the text
        inner = live[lat.dst[edge_of[live]] >= 0]
        rest = self.word_first[live + 1] - word_at[live] - 1
        after = np.arange(int(rest.sum())) + np.repeat(word_at[live] + 1 - np.cumsum(rest) + rest, rest)
        doc_rows, word_rows = np.r_[inner, self.doc[after]], np.r_[word_at[inner], after]
        node_rows, step_rows = np.r_[lat.dst[edge_of[inner]], self.start[after]], np.r_[step_at[inner] + 1, np.zeros(len(after), np.int64)]
        order = tb.stable_order(doc_rows)  # the branching word, then the later ones, which ascend
        doc_rows, word_rows, node_rows, step_rows = doc_rows[order], word_rows[order], node_rows[order], step_rows[order]
        edges, which, steps = self.complete(j, doc_rows, word_rows - self.word_first[doc_rows], node_rows, step_rows)
        bounds = np.searchsorted(doc_rows[which], np.arange(n + 1)) if len(which) else np.zeros(n + 1, np.int64)
        path = dict(edges=edges, word=word_rows[which], step=steps, bounds=bounds, base=base, top=value, shared=shared)
        self._value(path, j)
        paths.append(path)
        for d in live.tolist():
            whole = np.concatenate((heads[d], edges[bounds[d] : bounds[d + 1]]))
            found[d].append((whole, float(lat.logp[whole].sum()), float(value[d])))


def _framed(col: pa.Array) -> pa.Array:
    """Each text that isn't empty with the space that stands in front of it."""
    import pyarrow.compute as pc

    b = pc.fill_null(col.cast(pa.large_binary()), b"")
    return pc.if_else(pc.equal(pc.binary_length(b), 0), b, pc.binary_join_element_wise(pa.scalar(b"", pa.large_binary()), b, pa.scalar(b" ", pa.large_binary())))


def sampled(keys: np.ndarray, col: pa.Array, samples: int = SAMPLES, model: str = MODEL, alpha: float = ALPHA, seed: int = SEED, lattice: Lattice | None = None):
    """(first row, samples of each row) of one slice of texts after another.

    A sample is (ids, log-probability, value, inclusion), best value first.
    ``lattice`` may be handed from one column to the next of the same model.
    """
    lattice = lattice or Lattice(vocabulary(model, alpha), WORD_BYTES)
    for data, off, rows in tb.slices(_framed(col), SLICE_BYTES, whole=True):
        if not len(data):
            yield int(rows[0]), [[(np.empty(0, np.int32), 0.0, 0.0, 1.0)] for _ in rows]
            continue
        search = Search(lattice, data, off, keys[rows], samples, seed)
        out = []
        for found, kappa in zip(search.run(), search.kappa.tolist(), strict=True):
            out.append([(lattice.ids[e], lp, v, 1.0 if kappa == -np.inf else float(-np.expm1(-np.exp(min(lp - kappa, 50.0))))) for e, lp, v in found])
        del search
        yield int(rows[0]), out
        del out
    tb.release()


def sample_segmentations(keys: np.ndarray, col: pa.Array, **options) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """The samples of each text of a column."""
    return [row for _, part in sampled(keys, col, **options) for row in part]


def decode(ids: np.ndarray, model: str = MODEL, alpha: float = ALPHA) -> bytes:
    """The text of a segmentation, as UTF-8."""
    return vocabulary(model, alpha).decode(np.asarray(ids, np.int64)).tobytes()[1:]


SCHEMA = "array<struct<ids:array<int>,logp:double,value:double,inclusion:double,decoded_crc32:bigint>>"


def _column(part: list[list[tuple]], vocab: Vocabulary) -> pa.Array:
    flat = [s for row in part for s in row]
    n = [len(s[0]) for s in flat]
    ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(np.concatenate([s[0] for s in flat]) if flat else np.empty(0, np.int32)))
    every = ids.values.to_numpy()
    size = np.r_[0, np.cumsum(vocab.size[every])][np.r_[0, np.cumsum(n)]].tolist() if flat else [0]
    text = memoryview(vocab.decode(every))
    crc = [zlib.crc32(text[min(a + 1, b) : b]) for a, b in itertools.pairwise(size)]
    items = pa.StructArray.from_arrays([ids, *(pa.array([s[i] for s in flat], pa.float64()) for i in (1, 2, 3)), pa.array(crc, pa.int64())], ["ids", "logp", "value", "inclusion", "decoded_crc32"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r) for r in part])].astype(np.int32)), items)


def with_segmentations(docs: DataFrame, id_col: str = "doc_id", text: str = "text", out: str = "segmentations", samples: int = SAMPLES, model: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """The documents with their sampled segmentations; each carries the checksum of its decoding."""
    docs = docs.drop(out)
    keyed = docs.withColumn("__draws", F.col(id_col).cast("bigint") if isinstance(docs.schema[id_col].dataType, IntegralType) else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col)))
    value = docs.columns.index(text)

    def run(batches):
        lattice = Lattice(vocabulary(model, alpha), WORD_BYTES)
        for batch in batches:
            k = batch.column(batch.num_columns - 1).fill_null(0).to_numpy(zero_copy_only=False)
            for first, part in sampled(k, batch.column(value), samples, model, alpha, seed, lattice):
                rows = batch.slice(first, len(part))
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], _column(part, vocabulary(model, alpha))], [*rows.schema.names[:-1], out])

    schema = StructType([*docs.schema.fields, *StructType.fromDDL(f"{out} {SCHEMA}").fields])
    return keyed.mapInArrow(run, schema)


def op3_segmentation(spark, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document, with sizes, hashes and scores; see the module."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = with_segmentations(docs)
    s = F.col("segmentations")
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0))
    return got.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.size(s).alias("n_samples"), F.transform(s, lambda x: F.size(x["ids"])).alias("n_pieces"), F.transform(s, lambda x: x["ids"]).alias("ids"),
        F.transform(s, lambda x: F.xxhash64(x["ids"])).alias("ids_xxhash64"), F.transform(s, lambda x: x["logp"]).alias("logp"), F.transform(s, lambda x: x["inclusion"]).alias("inclusion"),
        F.forall(s, lambda x: x["decoded_crc32"] == crc).alias("round_trip"),
    )
