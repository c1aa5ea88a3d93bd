"""Plane sweep over tiles: few candidates are looked at, and k of them leave a task.

Tiles are long and flat: stripes of y a few neighbours high, cut along x where
they hold TILE_ROWS candidates.  A task has a tile's candidates in order of x and
the points that are to be compared with them.  The candidates next to a point by x
bound its k-th distance, and the sweep ends on either side where a candidate is
farther than that by x alone.  Where such an end lies far off, the bound is taken
anew from a window twice as wide.  All points of a tile move at once.

Round one sweeps each point's own tile, which bounds its k-th distance (where a
tile holds fewer than k, the far corners of a run of tiles do), and names the
other tiles whose box is within the bound.  Round two sweeps those, by the bound
from the start.  Both leave states of k neighbours a point and tile, which are
merged; a point whose bound stays inside its tile is done after round one.

Both joins are by tile.  A tile with more than MOST_POINTS points is dealt out:
its candidates, TILE_ROWS or so, go to each part.  Up to MAX_BLOCKS tiles have
their boxes on the driver; beyond TILE_ROWS x MAX_BLOCKS candidates tiles grow.
Round one's rows are a table in the shared folder, as both rounds' ends read them.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from ..functions import optimal_stripes
from ..operators.sketches import boundaries
from ..operators.states import STATE, best, lists, merge_states, ranked
from ..sources.scratch import kept
from .tiles import CROWDED, FEWEST, MAX_BLOCKS, Boxes, Grid, _boxes, _located, _ranges as ranges, build_grid

#: Candidates in a tile, about; height of a stripe in stripes of the optimal number; points of a tile that go to one task.
TILE_ROWS, HEIGHT, MOST_POINTS = 4096, 3, 65_536
#: Distances taken at once, and rows a task should get.
CELLS, TASK_ROWS = 1 << 20, 1_000_000
FIRST = "input_id bigint, v double, u double, bound double, ids array<bigint>, far array<double>, seen bigint, others array<int>"


def swept(qu: np.ndarray, qv: np.ndarray, limit: np.ndarray, cu: np.ndarray, cv: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(point's place, squared distance, id) of each point's k nearest within its limit, in order; and how many distances each point took."""
    order = np.argsort(cu, kind="stable")
    cu, cv, ids = cu[order], cv[order], ids[order]
    n, start = len(cu), np.searchsorted(cu, qu)
    seen, left, w = np.zeros(len(qu), np.int64), np.arange(len(qu)), 2 * k
    found: list[tuple[np.ndarray, ...]] = []

    def apart(p: np.ndarray, at: np.ndarray) -> np.ndarray:
        du, dv = cu[at] - qu[p], cv[at] - qv[p]
        return du * du + dv * dv

    while len(left):
        w, more = min(w, n), []
        step = max(1, CELLS // (2 * w))
        for p in (left[i : i + step] for i in range(0, len(left), step)):
            bound = limit[p]
            if np.isinf(bound).any() and 2 * w >= k:
                at = start[p][:, None] + np.arange(-w, w)
                inside = (at >= 0) & (at < n)
                d = np.where(inside, apart(p[:, None], np.clip(at, 0, n - 1)), np.inf)
                bound = np.minimum(bound, np.partition(d, k - 1, 1)[:, k - 1])
                seen[p] += inside.sum(1)
            side = np.sqrt(bound) * (1 + 1e-12)  # rounded up: the exact comparison follows
            lo, hi = np.searchsorted(cu, qu[p] - side, "left"), np.searchsorted(cu, qu[p] + side, "right")
            fits = (hi - lo <= 4 * w) | (w == n) | np.isfinite(limit[p])
            more.append(p[~fits])
            p, lo, hi, bound = p[fits], lo[fits], hi[fits], bound[fits]
            seen[p] += hi - lo
            total = np.r_[0, np.cumsum(hi - lo)]
            cut = 0
            while cut < len(p):  # so many points that their windows hold CELLS candidates
                end = max(cut + 1, int(np.searchsorted(total, total[cut] + CELLS, "right")) - 1)
                i, at = ranges(lo[cut:end], hi[cut:end])
                i += cut
                d = apart(p[i], at)
                near = d <= bound[i]
                found.append((p[i[near]], d[near], ids[at[near]]))
                cut = end
        left, w = np.concatenate(more), 2 * w
    owner, far, near = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
    keep = best(owner, far, near, k)
    return owner[keep], far[keep], near[keep], seen


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[c].to_numpy() for c in names]


class Ends:
    """What follows from a tile's sweep: bounds, and other tiles in reach."""

    def __init__(self, boxes: Boxes, k: int) -> None:
        self.boxes, self.k = boxes, k
        self.first, self.last = boxes.runs(k)

    def bound(self, tile: int, v: np.ndarray, u: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """The k-th distance, or for points without (nan) the far corner of a run of tiles that holds k, or nothing bounds them."""
        at = int(np.searchsorted(self.boxes.block, tile))
        run = slice(int(self.first[at]), int(self.last[at]) + 1)
        short = np.flatnonzero(np.isnan(kth))
        if len(short) and self.boxes.count[run].sum() >= self.k:
            far = np.zeros(len(short))
            for low, high in zip(self.boxes.low[run], self.boxes.high[run], strict=True):
                gaps = [np.maximum(np.abs(low[a] - x[short]), np.abs(high[a] - x[short])) for a, x in enumerate((v, u))]
                far = np.maximum(far, gaps[0] * gaps[0] + gaps[1] * gaps[1])
            kth = kth.copy()
            kth[short] = far
        return kth

    def others(self, tile: int, v: np.ndarray, u: np.ndarray, bound: np.ndarray) -> pa.Array:
        owner, block = self.boxes.reach(v, u, bound)
        owner, block = owner[block != tile], block[block != tile]
        order = np.argsort(owner, kind="stable")
        return lists(block[order], np.bincount(owner, minlength=len(v)), pa.int32())


def first_round(ends: Ends, k: int) -> Callable[..., pa.Table]:
    """Sweeps a tile's own points: their states, bounds and the other tiles in reach."""

    def first(key, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, v, u = _columns(left, "input_id", "v", "u")
        cv, cu, cid = _columns(right, "tv", "tu", "neighbor_id")
        owner, far, near, seen = swept(u, v, np.full(len(ids), np.inf), cu, cv, cid, k)
        sizes = np.bincount(owner, minlength=len(ids))
        kth = np.full(len(ids), np.nan)
        whole = sizes == k
        kth[whole] = far[np.cumsum(sizes)[whole] - 1]
        bound = ends.bound(key[0].as_py(), v, u, kth)
        columns = [pa.array(ids), pa.array(v), pa.array(u), pa.array(bound, from_pandas=True), lists(near, sizes, pa.int64()), lists(far, sizes, pa.float64()), pa.array(seen), ends.others(key[0].as_py(), v, u, bound)]
        return pa.table(columns, names=[f.split()[0] for f in FIRST.split(", ")])

    return first


def second_round(k: int) -> Callable[..., pa.Table]:
    """Sweeps a tile for points of other tiles, within their bounds: states."""

    def second(_, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, v, u = _columns(left, "input_id", "v", "u")
        limit = left["bound"].cast(pa.float64()).to_numpy()
        cv, cu, cid = _columns(right, "tv", "tu", "neighbor_id")
        owner, far, near, seen = swept(u, v, np.where(np.isnan(limit), np.inf, limit), cu, cv, cid, k)
        sizes = np.bincount(owner, minlength=len(ids))
        return pa.table([pa.array(ids), lists(near, sizes, pa.int64()), lists(far, sizes, pa.float64()), pa.array(seen)], names=["input_id", "ids", "far", "seen"])

    return second


def dealt(points: DataFrame, training: DataFrame, tasks: int) -> tuple[DataFrame, DataFrame]:
    """Both sides by (tile, part) in that many tasks."""
    return tuple(s.repartition(tasks, "tile", "part") for s in parted(points, training))


def parted(points: DataFrame, training: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with a part; parts are more than one where a tile has too many points."""
    hot = points.groupBy("tile").count().where(F.col("count") > MOST_POINTS).collect()  # tiles at most
    if not hot:
        return points.withColumn("part", F.lit(0)), training.withColumn("part", F.lit(0))
    spark = points.sparkSession
    parts = F.broadcast(spark.createDataFrame([(r["tile"], -(-r["count"] // MOST_POINTS)) for r in hot], "tile int, parts int"))
    count = F.coalesce("parts", F.lit(1))
    return (
        points.join(parts, "tile", "left").withColumn("part", F.pmod(F.xxhash64("input_id"), count).cast("int")).drop("parts"),
        training.join(parts, "tile", "left").withColumn("part", F.explode(F.sequence(F.lit(0), count - 1))).drop("parts"),
    )


@dataclass
class Tiles:
    """Candidates cut into tiles: boundaries, boxes, and a table (tile, neighbor_id, tv, tu)."""

    grid: Grid
    boxes: Boxes
    rows: DataFrame


def cut(candidates: DataFrame, k: int, n: int, stripes: int | None = None, sketched: DataFrame | None = None) -> Tiles:
    """The tiles of n candidates (id, x, y), n > 0; stripes are cut by sketches of y where there are some."""
    t = _points(candidates)
    rows = max(TILE_ROWS, FEWEST * k, n // MAX_BLOCKS)
    stripes = max(1, min(stripes or optimal_stripes(n, k) // HEIGHT, n, MAX_BLOCKS))
    grid = build_grid(t, stripes, max(1, math.ceil(n / rows / stripes)), None if sketched is None else boundaries(sketched, stripes))
    training = _located(t, grid)
    boxes = _boxes(training)
    if boxes.count.max() > CROWDED * rows:  # of candidates at one location only the k smallest ids count
        order = Window.partitionBy("v", "u").orderBy("id")
        training = training.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")
        boxes = _boxes(training)
    return Tiles(grid, boxes, training.select(F.col("block").alias("tile"), "stripe", F.col("id").alias("neighbor_id"), F.col("v").alias("tv"), F.col("u").alias("tu")))


def _points(df: DataFrame) -> DataFrame:
    return df.select("id", F.col("y").alias("v"), F.col("x").alias("u"))


def sweep_states(queries: DataFrame, candidates: DataFrame, k: int, stripes: int | None = None, **_: object) -> tuple[DataFrame, DataFrame]:
    """(states, seen): each point's k nearest, and (input_id, n), how many distances were taken for it."""
    n = candidates.count()
    if n == 0:
        nothing = queries.limit(0).select(F.col("id").alias("input_id"))
        return nothing.select("input_id", F.array().cast("array<bigint>").alias("ids"), F.array().cast("array<double>").alias("far")), nothing.withColumn("n", F.lit(0).cast("bigint"))
    tiles = cut(candidates, k, n, stripes)
    tasks = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(n + queries.count()) // TASK_ROWS))
    return rounds(queries, tiles, k, lambda points: tuple(s.groupBy("tile", "part") for s in dealt(points, tiles.rows.drop("stripe"), tasks)))


def at_home(points: DataFrame, tiles: Tiles) -> DataFrame:
    """(tile, input_id, v, u): points (id, x, y) in their tiles, or the next where those have no candidates."""
    filled = tiles.boxes.block
    home = F.arrow_udf(lambda b: pa.array(filled[np.minimum(np.searchsorted(filled, b.to_numpy(zero_copy_only=False)), len(filled) - 1)].astype(np.int32)), "int")
    return _located(_points(points), tiles.grid).select(home("block").alias("tile"), F.col("id").alias("input_id"), "v", "u")


def rounds(queries: DataFrame, tiles: Tiles, k: int, sides: Callable[[DataFrame], tuple[GroupedData, GroupedData]]) -> tuple[DataFrame, DataFrame]:
    """Both rounds; ``sides`` groups points (tile, input_id, ...) and the candidates of their tiles alike, by tile first."""
    ends, asked = Ends(tiles.boxes, k), at_home(queries, tiles)
    left, right = sides(asked)
    one = kept(left.cogroup(right).applyInArrow(_asked_only(first_round(ends, k)), FIRST))
    left, right = sides(one.select("input_id", "v", "u", "bound", F.explode("others").alias("tile")))
    two = left.cogroup(right).applyInArrow(_asked_only(second_round(k)), f"{STATE}, seen bigint")
    state = ["input_id", "ids", "far"]
    alone = F.size("others") == 0
    states = one.where(alone).select(*state).unionByName(merge_states(one.where(~alone).select(*state).unionByName(two.select(*state)), k))
    seen = one.select("input_id", "seen").unionByName(two.select("input_id", "seen")).groupBy("input_id").agg(F.sum("seen").alias("n"))
    return states, seen


def _asked_only(f):
    """Groups without points give nothing."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = f(key, left, right) if left.num_rows else None
        return out if out is not None else pa.table({})

    return run


def sweep(queries: DataFrame, candidates: DataFrame, k: int, **options: object) -> DataFrame:
    """The join by plane sweep; ``stripes``: how many (by default from the sizes)."""
    return ranked(sweep_states(queries, candidates, k, **options)[0])
