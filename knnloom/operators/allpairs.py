"""The nested loop by blocks: all pairs of points and candidates, of which no pair is ever a row.

Points are dealt to packs by a hash of their id.  Candidates are cut into chunks in
order of id, and each pack gets all chunks in that order.  A task holds a pack and
what is kept of it so far, a few numbers a point, while the chunks stream by; the
distances of some points to some candidates are a matrix of CELLS at most.  Work is
quadratic, as asked; memory is bounded, and what is shuffled is the candidates once a
pack of PACK points.

Points are finite, and ids are unique on each side.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .states import STATE, best, lists

#: Points of a pack at most; packs that small sets are cut into, and points that are worth one.
PACK, PACKS, FEW = 16_384, 48, 512
#: Candidates of a chunk, and candidates that all points of a pack meet at once, at most.
CHUNK, STEP = 256, 4096
#: Distances taken at once, and pairs held before all but the kept ones go.
CELLS, HELD = 1 << 16, 1 << 20
CHUNKS = "pack int, side int, first bigint, ids binary, x binary, y binary"
_KINDS = (np.int64, np.float64, np.float64)


def _chunks(side: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (pack, id, x, y), of one pack a task, to CHUNKS."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pack = batch.column(0).to_pylist()
            columns = [batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(3)]
            cuts = range(0, batch.num_rows, CHUNK)
            data = [pa.array([np.ascontiguousarray(c[a : a + CHUNK], kind).tobytes() for a in cuts], pa.binary()) for c, kind in zip(columns, _KINDS, strict=True)]
            heads = [pa.array([pack[a] for a in cuts], pa.int32()), pa.array([side] * len(cuts), pa.int32()), pa.array([int(columns[0][a]) for a in cuts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*heads, *data], [f.split()[0] for f in CHUNKS.split(", ")])

    return made


class Pack:
    """Points that candidates stream past in order of id; what is kept of them is up to the subclass."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, y: np.ndarray, k: int) -> None:
        self.ids, self.x, self.y, self.k, self.seen = ids, x, y, k, 0
        self.limit = np.full(len(ids), np.inf)  # the k-th distance so far

    def feed(self, ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            n = min(self.k - self.seen, STEP) if self.seen < self.k else min(3 * self.seen, STEP)  # at first few, so that the limits fall soon
            c = slice(at, at + n)
            self._meet(ids[c], x[c], y[c])
            at += n

    def _meet(self, ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        m, open_ = len(ids), self.seen < self.k
        step = max(1, CELLS // m)
        for a in range(0, len(self.ids), step):
            b = min(a + step, len(self.ids))
            d, e = x[None, :] - self.x[a:b, None], y[None, :] - self.y[a:b, None]
            d *= d
            e *= e
            d += e
            hit = np.arange(d.size) if open_ else np.flatnonzero(self.near(d, self.limit[a:b, None]))
            if len(hit):
                self.take(a + hit // m, d.ravel()[hit], ids[hit % m])
        self.seen += m
        self.settle()


class Nearest(Pack):
    """The k nearest; ties go to the smaller id."""

    near = staticmethod(np.less_equal)

    def __init__(self, ids: np.ndarray, x: np.ndarray, y: np.ndarray, k: int) -> None:
        super().__init__(ids, x, y, k)
        self.far, self.best = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.found: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def take(self, owner: np.ndarray, far: np.ndarray, ids: np.ndarray) -> None:
        self.found.append((owner, far, ids))
        self.held += len(owner)
        if self.held > HELD:
            self.settle()

    def settle(self) -> None:
        if not self.found:
            return
        owner, far, ids = (np.concatenate(c) for c in zip(*self.found, strict=True))
        self.found, self.held = [], 0
        who = np.unique(owner)
        owner = np.r_[np.repeat(who, self.k), owner]
        far, ids = np.r_[self.far[who].ravel(), far], np.r_[self.best[who].ravel(), ids]
        keep = best(owner, far, ids, self.k)  # k for each, as empty places count
        self.far[who], self.best[who] = far[keep].reshape(-1, self.k), ids[keep].reshape(-1, self.k)
        self.limit[who] = self.far[who, -1]

    def rows(self) -> Iterator[pa.RecordBatch]:
        n = min(self.k, self.seen)
        for a in range(0, len(self.ids), STEP):
            part = slice(a, a + STEP)
            sizes = np.full(len(self.ids[part]), n)
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[part]), lists(self.best[part, :n].ravel(), sizes, pa.int64()), lists(self.far[part, :n].ravel(), sizes, pa.float64())], ["input_id", "ids", "far"])


class Additions(Pack):
    """How often a heap of k takes a candidate: if fewer than k earlier ones are at most as far."""

    near = staticmethod(np.less)

    def __init__(self, ids: np.ndarray, x: np.ndarray, y: np.ndarray, k: int) -> None:
        super().__init__(ids, x, y, k)
        self.heaps: list[list[float]] = [[] for _ in ids]
        self.taken = [0] * len(ids)
        self.touched: set[int] = set()

    def take(self, owner: np.ndarray, far: np.ndarray, ids: np.ndarray) -> None:
        owners = owner.tolist()
        for o, d in zip(owners, far.tolist(), strict=True):
            heap = self.heaps[o]
            if len(heap) < self.k:
                heapq.heappush(heap, -d)
                self.taken[o] += 1
            elif d < -heap[0]:
                heapq.heapreplace(heap, -d)
                self.taken[o] += 1
        self.touched.update(owners)

    def settle(self) -> None:
        if self.seen >= self.k:
            who = list(self.touched)
            self.limit[who] = [-self.heaps[o][0] for o in who]
            self.touched.clear()

    def rows(self) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(self.ids), pa.array(self.taken, pa.int64())], ["input_id", "additions"])


def _streamed(kind: type[Pack], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """CHUNKS of one pack a task, points first, to what is kept of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points: list[list[np.ndarray]] = []
        pack = None
        for batch in batches:
            side = batch.column(1).to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(side, 1))
            columns = lambda a, b: [np.frombuffer(b"".join(batch.column(c + 3).slice(a, b - a).to_pylist()), kind) for c, kind in enumerate(_KINDS)]  # noqa: B023, E731
            if cut:
                points.append(columns(0, cut))
            if cut == batch.num_rows or not points:
                continue
            if pack is None:
                pack = kind(*(np.concatenate(c) for c in zip(*points, strict=True)), k)
            for a in range(cut, batch.num_rows, STEP // CHUNK * 16):
                pack.feed(*columns(a, min(a + STEP // CHUNK * 16, batch.num_rows)))
        if pack is not None:
            yield from pack.rows()

    return run


def _all_pairs(queries: DataFrame, candidates: DataFrame, kind: type[Pack], k: int, schema: str, n: int | None = None) -> DataFrame:
    plain = lambda df: df.select(F.col("id").cast("bigint").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    q, t = plain(queries), plain(candidates)
    n = q.count() if n is None else n
    packs = max(1, -(-n // PACK), min(PACKS, -(-n // FEW)))
    number = F.pmod(F.xxhash64("id"), F.lit(packs)).cast("int").alias("pack")
    points = q.select(number, "id", "x", "y").repartitionById(packs, "pack").mapInArrow(_chunks(0), CHUNKS)
    ordered = t.repartitionByRange("id").sortWithinPartitions("id").select(F.lit(0).alias("pack"), "id", "x", "y").mapInArrow(_chunks(1), CHUNKS)
    every = ordered.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))))
    both = points.unionByName(every).repartitionById(packs, "pack").sortWithinPartitions("side", "first")
    return both.mapInArrow(_streamed(kind, k), schema)


def nested_states(queries: DataFrame, candidates: DataFrame, k: int, n_input: int | None = None) -> DataFrame:
    """The state (input_id, ids, far) of each point's k nearest, by taking the distances of all pairs; none without candidates."""
    return _all_pairs(queries, candidates, Nearest, k, STATE, n_input)


def heap_additions(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(input_id, additions): how often a bounded heap of k, fed in order of id, takes a candidate.

    A candidate is taken if fewer than k earlier ones are at most as far.
    """
    return _all_pairs(queries, candidates, Additions, k, "input_id bigint, additions bigint")
