"""A stream of candidates: the k nearest of each point are kept as state, and what changes comes out.

``prepare`` joins the points with the candidates that are known (there may be none)
and writes the seeds below a path: the points in tiles of about TILE_POINTS, each
with its state, and a row a tile of its box and reach, the largest k-th distance
of its points.  Bounds only fall, so a candidate that comes later matters to a tile
only if its box is within that reach, whatever came between; ``updates`` sends it
there and nowhere else.  Tiles whose points have fewer than k neighbours get every
candidate, so know k at least.

``updates`` is a streaming DataFrame, by ``transformWithState`` over tiles, with a
row for each point and batch whose neighbours changed: (input_id, version, ids, far).
A batch's candidates of a tile are swept in Arrow batches against all its points;
memory is bounded by these, work by the trigger's size.  ``current`` gives the
join's rows from the seeds and the updates so far, which equal the batch join with
all candidates.  The seeds are written once and read again on a restart, so keys
and routes stay as they were.

A place with many points is several tiles (by hash of id); boxes, at most
MAX_BLOCKS, are sent with the tasks, and tiles grow beyond that.  Ids must be unique over all
candidates; points and candidates that aren't finite are left out.  State is in
RocksDB: ``start`` sets the session to it while a query starts, and, told where the
seeds are, to as many partitions of state as their tiles fill.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import finite_points
from ..operators.states import best, ranked
from ..plans.sweep import sweep_states, swept
from ..plans.tiles import MAX_BLOCKS, _located, _ranges, build_grid
from ..sources.scratch import drop_kept, kept, kept_tables

TILE_POINTS = 4096
#: Tiles that share a partition of state, about: each partition starts a worker and a store of its own in every batch.
SHARED_TILES = 8
#: Distances of candidates and boxes taken at once.
CELLS = 1 << 20
UPDATE = "input_id bigint, version bigint, ids array<bigint>, far array<double>"
_STATE = "input_id binary, v binary, u binary, sizes binary, ids binary, far binary, version bigint"
_KINDS = {"input_id": np.int64, "v": np.float64, "u": np.float64, "sizes": np.int64, "ids": np.int64, "far": np.float64}
_PROVIDER, _PARTITIONS = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"


def prepare(points: DataFrame, known: DataFrame, k: int, path: str) -> None:
    """Writes the seeds of points and known candidates, both (id, x, y)."""
    if k < 1:
        raise ValueError("k must be at least 1")
    spark, first = points.sparkSession, kept_tables()
    q, t = (kept(finite_points(p)) for p in (points, known))  # read a dozen times
    n = q.count()
    spark.createDataFrame([(k,)], "k int").coalesce(1).write.parquet(f"{path}/about")
    at = q.select("id", F.col("y").alias("v"), F.col("x").alias("u"))
    rows = max(TILE_POINTS, 2 * n // MAX_BLOCKS)
    side = max(1, math.isqrt(-(-n // rows)))
    placed = _located(at, build_grid(at, side, max(1, -(-n // (rows * side)))))
    parts = placed.groupBy("block").agg(F.ceil(F.count("*") / (2 * rows)).alias("parts"))  # crowds are several tiles
    tile = F.struct("block", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
    states = sweep_states(q, t, k)[0]
    none = [F.array().cast(f"array<{c}>") for c in ("bigint", "double")]
    seeds = placed.join(F.broadcast(parts), "block").select(tile.alias("place"), F.col("id").alias("input_id"), "v", "u").join(states, "input_id", "left")
    seeds.select("place", "input_id", "v", "u", F.coalesce("ids", none[0]).alias("ids"), F.coalesce("far", none[1]).alias("far")).write.parquet(f"{path}/placed")
    seeds = spark.read.parquet(f"{path}/placed")
    kth = F.when(F.size("far") == k, F.element_at("far", -1)).otherwise(F.lit(float("inf")))
    boxes = seeds.groupBy("place").agg(F.min("v").alias("v0"), F.min("u").alias("u0"), F.max("v").alias("v1"), F.max("u").alias("u1"), F.max(kth).alias("reach"))
    got = boxes.collect()  # one row a tile
    numbered = [(i, r["place"]["block"], r["place"]["part"], *r[1:]) for i, r in enumerate(sorted(got, key=lambda r: tuple(r["place"])))]
    spark.createDataFrame(numbered, "tile int, block int, part bigint, v0 double, u0 double, v1 double, u1 double, reach double").coalesce(1).write.parquet(f"{path}/boxes")
    number = spark.read.parquet(f"{path}/boxes").select("tile", F.struct("block", "part").alias("place"))
    seeds.join(F.broadcast(number), "place").drop("place").write.parquet(f"{path}/seeds")
    drop_kept(spark, first)


class Routes:
    """Which tiles a candidate matters to: slabs of v, each with the tiles whose reach meets it."""

    def __init__(self, boxes: pd.DataFrame) -> None:
        b = boxes.sort_values("tile")
        self.tile, self.reach = b["tile"].to_numpy(np.int32), b["reach"].to_numpy(float)
        self.low, self.high = b[["v0", "u0"]].to_numpy(float), b[["v1", "u1"]].to_numpy(float)
        side = np.sqrt(self.reach) * (1 + 1e-12)  # rounded up: the exact comparison follows
        v0, v1 = self.low[:, 0] - side, self.high[:, 0] + side
        self.cuts = np.unique(np.quantile(self.low[:, 0], np.linspace(0, 1, math.isqrt(len(b)) + 1)))[1:-1] if len(b) else np.empty(0)
        box, slab = _ranges(np.searchsorted(self.cuts, v0, "right"), np.searchsorted(self.cuts, v1, "right") + 1)
        order = np.argsort(slab, kind="stable")
        self.boxes, self.starts = box[order], np.searchsorted(slab[order], np.arange(len(self.cuts) + 2))

    def of(self, v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(candidate's place, tile) of all in reach."""
        slab, found = np.searchsorted(self.cuts, v, "right"), [(np.empty(0, np.int64), np.empty(0, np.int32))]
        order = np.argsort(slab, kind="stable")
        edges = np.searchsorted(slab[order], np.arange(len(self.cuts) + 2))
        for s in np.flatnonzero(np.diff(edges)):
            mine, box = order[edges[s] : edges[s + 1]], self.boxes[self.starts[s] : self.starts[s + 1]]
            step = max(1, CELLS // max(1, len(box)))
            for i in (mine[a : a + step] for a in range(0, len(mine), step)):
                gap = [np.maximum(np.maximum(self.low[box, a] - x[i, None], x[i, None] - self.high[box, a]), 0) for a, x in enumerate((v, u))]
                c, j = np.nonzero(gap[0] * gap[0] + gap[1] * gap[1] <= self.reach[box])
                found.append((i[c], self.tile[box[j]]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Nearest(StatefulProcessor):
    """The points of a tile and their k nearest so far, as arrays of one value."""

    def __init__(self, k: int) -> None:
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("nearest", _STATE)

    def _put(self, state: dict[str, np.ndarray], version: int) -> None:
        self.held.update((*(np.ascontiguousarray(state[c], kind).tobytes() for c, kind in _KINDS.items()), version))

    def _get(self) -> tuple[dict[str, np.ndarray], int]:
        *arrays, version = self.held.get()
        return {c: np.frombuffer(bytes(a), kind) for a, (c, kind) in zip(arrays, _KINDS.items(), strict=True)}, int(version)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        s = initialState
        new = {c: s[c].to_numpy() for c in ("input_id", "v", "u")}
        new["sizes"] = np.array([len(x) for x in s["ids"]], np.int64)
        new |= {c: np.concatenate([np.asarray(x, _KINDS[c]) for x in s[c]]) for c in ("ids", "far")}
        version = 0
        if self.held.exists():  # a tile's rows may come in several batches
            old, version = self._get()
            new = {c: np.concatenate([old[c], new[c]]) for c in _KINDS}
        self._put(new, version)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, version = self._get()
        n, changed = len(state["input_id"]), np.zeros(len(state["input_id"]), bool)
        for batch in rows:
            sizes, ends = state["sizes"], np.cumsum(state["sizes"])
            limit = np.full(n, np.inf)
            full = sizes == self.k
            limit[full] = state["far"][ends[full] - 1]
            owner, far, near, _ = swept(state["u"], state["v"], limit, *(batch[c].to_numpy() for c in ("u", "v", "neighbor_id")), self.k)
            if not len(owner):
                continue
            owner, far, near = np.r_[np.repeat(np.arange(n), sizes), owner], np.r_[state["far"], far], np.r_[state["ids"], near]
            keep = best(owner, far, near, self.k)
            changed[owner[keep[keep >= len(state["ids"])]]] = True
            state |= {"sizes": np.bincount(owner[keep], minlength=n), "ids": near[keep], "far": far[keep]}
        if not changed.any():
            return
        self._put(state, version + 1)
        ends, at = np.cumsum(state["sizes"]), np.flatnonzero(changed)
        cut = lambda c: [state[c][ends[i] - state["sizes"][i] : ends[i]] for i in at]
        yield pd.DataFrame({"input_id": state["input_id"][at], "version": version + 1, "ids": cut("ids"), "far": cut("far")})

    def close(self) -> None:
        pass


def updates(spark: SparkSession, path: str, arriving: DataFrame) -> DataFrame:
    """The streaming DataFrame of changed states, for an output in update mode; ``arriving`` streams (id, x, y)."""
    k = spark.read.parquet(f"{path}/about").first()["k"]
    routes = Routes(spark.read.parquet(f"{path}/boxes").toPandas())

    def tiles(v: pa.Array, u: pa.Array) -> pa.Array:
        owner, tile = routes.of(v.to_numpy(zero_copy_only=False), u.to_numpy(zero_copy_only=False))
        sizes = np.bincount(owner, minlength=len(v))
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(tile[np.argsort(owner, kind="stable")]))

    t = finite_points(arriving).select(F.col("id").alias("neighbor_id"), F.col("y").alias("v"), F.col("x").alias("u"))
    sent = t.withColumn("tile", F.explode(F.arrow_udf(tiles, "array<int>")("v", "u")))
    seeds = spark.read.parquet(f"{path}/seeds").groupBy("tile")
    return sent.groupBy("tile").transformWithStateInPandas(Nearest(k), UPDATE, "Update", "None", initialState=seeds)


def state_partitions(spark: SparkSession, path: str) -> int:
    """Partitions for the state of the seeds below ``path``: SHARED_TILES tiles each, two a core at least, the session's at most."""
    tiles = spark.read.parquet(f"{path}/boxes").count()
    return max(1, min(int(spark.conf.get(_PARTITIONS)), max(2 * spark.sparkContext.defaultParallelism, -(-tiles // SHARED_TILES))))


def start(changed: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, seeds: str | None = None, **trigger: object) -> StreamingQuery:
    """Starts the query of ``updates``; each batch of changes is handed to ``sink(changes, batch_id)``, again after a failure.

    ``seeds``: their path, which gives the partitions of state; a query keeps those it began with.
    """
    spark = changed.sparkSession
    new = {_PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    if seeds is not None:
        new[_PARTITIONS] = str(state_partitions(spark, seeds))
    before = {c: spark.conf.get(c) for c in new}
    try:
        for c, value in new.items():
            spark.conf.set(c, value)
        return changed.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)


def current(spark: SparkSession, path: str, changes: DataFrame | None = None) -> DataFrame:
    """The join's rows by the newest state of each point; changes that came twice count once."""
    states = spark.read.parquet(f"{path}/seeds").select("input_id", F.lit(0).cast("bigint").alias("version"), "ids", "far")
    if changes is not None:
        states = states.unionByName(changes.select("input_id", "version", "ids", "far"))
    newest = states.groupBy("input_id").agg(F.max_by(F.struct("ids", "far"), "version").alias("s"))
    return ranked(newest.select("input_id", "s.ids", "s.far"))
