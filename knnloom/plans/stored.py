"""Candidates stored once, in tiles, for joins with any number of point sets.

``store_candidates`` writes the sweep's tiles as a table that is partitioned by
band (a run of stripes) and bucketed by tile, with boundaries and boxes beside it.
``stored_join`` sweeps it: candidates aren't shuffled, for the table's buckets are
groups of tiles already, and points go to the buckets.  Of the bands only those
are read that hold a tile in reach: round two's reach is known when it begins, and
its bands prune the scan's partitions.

Tiles with more than MOST_POINTS points are dealt out as in the plain sweep, which
does shuffle the candidates that were read.  What is stored holds for any k up to
the one it was made for, since of a crowd at one location only so many are kept.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import finite_points
from ..operators.states import ranked
from . import sweep as plain
from .sweep import TASK_ROWS, Tiles, cut, dealt, rounds
from .tiles import Boxes, Grid

#: Partitions and buckets of a table, at most; each filled pair of them is a file.
BANDS, BUCKETS = 64, 256


@dataclass
class Stored:
    """An opened table."""

    tiles: Tiles
    k: int
    buckets: int
    bands: int

    def band(self, stripe: np.ndarray) -> np.ndarray:
        return band_of(stripe, len(self.tiles.grid.blocks), self.bands)


def band_of(stripe: np.ndarray, stripes: int, bands: int) -> np.ndarray:
    return (stripe.astype(np.int64) * bands // stripes).astype(np.int32)


def store_candidates(candidates: DataFrame, path: str, k: int, stripes: int | None = None, bands: int = BANDS, buckets: int | None = None, sketched: DataFrame | None = None) -> None:
    """Writes (id, x, y) as tiles below ``path``, for joins of up to k neighbours.

    ``sketched``: stored sketches of y, of the candidates or of other points that
    lie alike; they cut the stripes without a pass over the candidates.
    """
    t = finite_points(candidates)
    n = t.count()
    spark = candidates.sparkSession
    tiles = cut(t, k, n, stripes, sketched) if n else None
    many = len(tiles.grid.blocks) if n else 1
    bands, buckets = min(bands, many), buckets or max(1, min(BUCKETS, -(-n // TASK_ROWS)))
    about = spark.createDataFrame([(n, k, buckets, bands, many)], "n bigint, k int, buckets int, bands int, stripes int")
    about.coalesce(1).write.parquet(f"{path}/about")
    if not n:
        return
    name = f"knnloom_{uuid.uuid4().hex}"
    placed = tiles.rows.select(F.floor(F.col("stripe") * F.lit(bands).cast("bigint") / many).cast("int").alias("band"), "tile", "neighbor_id", "tv", "tu")
    placed.repartition(buckets, "tile").write.partitionBy("band").bucketBy(buckets, "tile").sortBy("tile", "tu").option("path", f"{path}/tiles").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay
    g, b = tiles.grid, tiles.boxes
    cuts = [(-1, i, float(x)) for i, x in enumerate(g.stripes)] + [(s, i, float(x)) for s, xs in enumerate(g.blocks) for i, x in enumerate(xs)]
    spark.createDataFrame(cuts, "stripe int, place int, cut double").coalesce(1).write.parquet(f"{path}/cuts")
    boxes = [(int(x), int(s), float(l[0]), float(l[1]), float(h[0]), float(h[1]), int(c)) for x, s, l, h, c in zip(b.block, b.stripe, b.low, b.high, b.count, strict=True)]
    spark.createDataFrame(boxes, "block int, stripe int, v0 double, u0 double, v1 double, u1 double, n bigint").coalesce(1).write.parquet(f"{path}/boxes")


def open_candidates(spark: SparkSession, path: str) -> Stored | None:
    """The table below ``path``; None if it has no candidates.  Boundaries and boxes, one row a tile, come to the driver."""
    about = spark.read.parquet(f"{path}/about").first()
    if not about["n"]:
        return None
    name = f"knnloom_{uuid.uuid4().hex}"
    at = path if "://" in path or path.startswith("file:") else f"file://{path}"
    spark.sql(f"CREATE TABLE {name} (tile INT, neighbor_id BIGINT, tv DOUBLE, tu DOUBLE, band INT) USING parquet PARTITIONED BY (band) CLUSTERED BY (tile) SORTED BY (tile, tu) INTO {about['buckets']} BUCKETS LOCATION '{at}/tiles'")
    spark.catalog.recoverPartitions(name)
    cuts = spark.read.parquet(f"{path}/cuts").toPandas().sort_values(["stripe", "place"])
    of = {s: g["cut"].to_numpy(float) for s, g in cuts.groupby("stripe")}
    grid = Grid(of.get(-1, np.empty(0)), [of.get(s, np.empty(0)) for s in range(about["stripes"])])
    got = spark.read.parquet(f"{path}/boxes").toPandas().sort_values("block")
    boxes = Boxes(got["block"].to_numpy(np.int64), got["stripe"].to_numpy(np.int64), got[["v0", "u0"]].to_numpy(float), got[["v1", "u1"]].to_numpy(float), got["n"].to_numpy(np.int64))
    return Stored(Tiles(grid, boxes, spark.table(name)), about["k"], about["buckets"], about["bands"])


def sides_of(stored: Stored, points: DataFrame) -> tuple:
    """Points and the candidates of their tiles, grouped by tile; only the points' bands are read."""
    boxes = stored.tiles.boxes
    tile, band = boxes.block, stored.band(boxes.stripe)
    where = F.arrow_udf(lambda t: plain.pa.array(band[np.searchsorted(tile, t.to_numpy(zero_copy_only=False))]), "int")
    needed = points.select(where("tile").alias("band")).distinct().where("band >= 0")  # one row a band at most
    read = stored.tiles.rows.join(F.broadcast(needed), "band", "left_semi").select("tile", "neighbor_id", "tv", "tu")
    if points.groupBy("tile").count().where(F.col("count") > plain.MOST_POINTS).limit(1).count():
        return tuple(s.groupBy("tile", "part") for s in dealt(points, read, max(stored.buckets, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    return points.repartition(stored.buckets, "tile").groupBy("tile"), read.groupBy("tile")


def stored_join(queries: DataFrame, stored: Stored | None, k: int) -> DataFrame:
    """The join of (id, x, y) with stored candidates: (input_id, rnk, neighbor_id, dist_sq)."""
    if k < 1 or stored and k > stored.k:
        raise ValueError(f"k must be from 1 to {stored.k if stored else 'any'}")
    q = finite_points(queries)
    if stored is None:
        empty = q.limit(0).select(F.col("id").alias("input_id"))
        return empty.select("input_id", F.lit(0).cast("bigint").alias("rnk"), F.col("input_id").alias("neighbor_id"), F.lit(0.0).alias("dist_sq"))
    return ranked(rounds(q, stored.tiles, k, lambda points: sides_of(stored, points))[0])
