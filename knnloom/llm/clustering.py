"""Centroid clustering of integer vectors, screened by block norms.

Components become integers, so sums, means and distances are exact and a rerun
gives the same clusters.  A vector is compressed to two numbers for each segment
of SEGMENT components: its sum over the root of the segment's length, and the
norm of what the segment's mean leaves.  By Cauchy-Schwarz the squared distance of
two compressed vectors is at most that of the vectors, so it is a lower bound
that costs a quarter of a distance.  Each vector takes exact distances from the
centroid of the least bound on, and stops where a bound exceeds the best.

Each round is one pass over a table of integers and compressed vectors, written
once.  What leaves a task is a sum and a count for each centroid; what comes to
the driver, and is sent out, is one row for each of the ``k`` centroids.

Defined cases.  Vectors that are null, of another length, or have a component
that is null or not finite are left out.  Integers are held within +-2^27, so
that squared distances of vectors of up to 128 components are bigints; sums
beyond a bigint are given as the largest one.  Rows of equal id are rows of their
own; a null id is hashed as the empty text.  Seeds tied by hash go by id, then by
components.  With fewer vectors than ``k`` each is a seed; seeds may be equal,
and the later of two equal centroids stays empty.  An empty table gives an empty
result.  Other columns are neither read nor returned; names that begin with ``__``
are not for input columns.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import pinned

WIDTH, SEGMENT, CENTROIDS, ROUNDS, SCALE = 64, 8, 40, 5, 256
#: Largest integer of a component.
LARGEST = 1 << 27
#: What rounding may take from a bound, relative to the squared norms.
SLACK = 1e-9
_MOST = (1 << 63) - 1


def compressed(q: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """[n, 2 x segments]: scaled sum and residual norm of each segment; squared norms stay the same."""
    parts = np.pad(q, ((0, 0), (0, -q.shape[1] % segment))).astype(np.float64).reshape(len(q), -(-q.shape[1] // segment), segment)
    total = parts.sum(2)
    rest = np.sqrt(((parts - total[:, :, None] / segment) ** 2).sum(2))
    return np.concatenate([total / np.sqrt(segment), rest], 1)


class Screen:
    """Centroids [k, width] that vectors are compared with; ``exact`` counts the distances taken."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        self.short = compressed(centroids)
        self.norm = (self.short**2).sum(1)
        self.exact = 0

    def nearest(self, q: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance); ties go to the smaller number."""
        both = (short**2).sum(1)[:, None] + self.norm[None, :]
        bound = both * (1 - SLACK) - 2 * (short @ self.short.T)
        order = np.argsort(bound, 1, kind="stable")
        bound = np.take_along_axis(bound, order, 1)
        best, least, rows = np.full(len(q), len(self.centroids)), np.full(len(q), _MOST), np.arange(len(q))
        for j in range(len(self.centroids)):
            rows = rows[bound[rows, j] <= least[rows]]
            if not len(rows):
                break
            c = order[rows, j]
            apart = q[rows].astype(np.int64) - self.centroids[c]
            d = np.einsum("ij,ij->i", apart, apart)
            self.exact += len(rows)
            nearer = (d < least[rows]) | (d == least[rows]) & (c < best[rows])
            best[rows[nearer]], least[rows[nearer]] = c[nearer], d[nearer]
        return best, least


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(-1, width)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)), pa.array(x.ravel()))


def integers(vectors: DataFrame, key: str, vector: str, width: int = WIDTH, scale: float = SCALE) -> DataFrame:
    """(key, q, short): the vectors that are kept, as integers and compressed."""

    def made(batches):
        for batch in batches:
            col = batch.column(1)
            whole = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(col), -1)) == width
            batch, col = batch.filter(pa.array(whole)), col.filter(pa.array(whole))
            x = np.asarray(col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)).reshape(-1, width)  # nulls become NaN
            fine = np.isfinite(x).all(1)
            q = np.clip(np.floor(x[fine] * scale), -LARGEST, LARGEST).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(fine)), _lists(q), _lists(compressed(q))], [key, "__q", "__short"])

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(f"`{key}`", F.col(f"`{vector}`").cast("array<double>")).mapInArrow(made, f"`{key}` {kind}, __q array<int>, __short array<double>")


def seeds(points: DataFrame, key: str, k: int, seed: int) -> np.ndarray:
    """The k vectors of the smallest hash of seed and key, in that order."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = points.select(drawn.alias("__drawn"), f"`{key}`", "__q").orderBy("__drawn", f"`{key}`", "__q").limit(k).collect()
    return np.array([r["__q"] for r in rows], np.int64)


def moved(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floor of the mean of their vectors, or as they were without any."""
    k, width = centroids.shape

    def sums(batches):
        screen, total, n = Screen(centroids), np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            q = _matrix(batch.column(0), width)
            at, _ = screen.nearest(q, _matrix(batch.column(1), screen.short.shape[1]))
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1]]) if len(at) else order
            total[at[order][first]] += np.add.reduceat(q[order], first, axis=0, dtype=np.int64) if len(at) else 0
            n += np.bincount(at, minlength=k)
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(n[full]), _lists(total[full])], ["cluster", "n", "total"])

    parts = points.select("__q", "__short").mapInArrow(sums, "cluster bigint, n bigint, total array<bigint>")
    whole = lambda c: F.sum(c.cast("decimal(38,0)"))
    after = centroids.copy()
    for r in parts.groupBy("cluster").agg(whole(F.col("n")).alias("n"), F.array(*(whole(F.col("total")[i]) for i in range(width))).alias("total")).collect():  # k rows at most
        after[r["cluster"]] = [int(t) // int(r["n"]) for t in r["total"]]
    return after


def clustered(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: float = SCALE, seed: int = 2) -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance) for each vector that is kept, and the final centroids."""
    points = pinned(integers(vectors, key, vector, width, scale))
    centroids = seeds(points, key, k, seed).reshape(-1, width)
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, cluster int, distance bigint"
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], schema), centroids
    for _ in range(rounds):
        centroids = moved(points, centroids)

    def assign(batches):
        screen = Screen(centroids)
        for batch in batches:
            at, d = screen.nearest(_matrix(batch.column(1), width), _matrix(batch.column(2), screen.short.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.astype(np.int32)), pa.array(d)], [key, "cluster", "distance"])

    return pinned(points.select(f"`{key}`", "__q", "__short").mapInArrow(assign, schema)), centroids


def op11_clustering(spark, sf_dir: str) -> DataFrame:
    """Every vector with its cluster; see the module for the defined cases."""
    rows, centroids = clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # one row a centroid
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    whole = min(sum(sums.values()), _MOST)
    about = spark.createDataFrame([(c, min(s, _MOST), whole, digest[c]) for c, s in sorted(sums.items())], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(greatest(-{LARGEST}, least({LARGEST}, floor({SCALE} * CAST(x AS DOUBLE)))) AS BIGINT)) AS q
FROM embeddings WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "p AS MATERIALIZED (SELECT r, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM v)",
        f"s AS (SELECT r, row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), vec_id, q) - 1 AS k FROM v QUALIFY k < {CENTROIDS})",
        "c0 AS MATERIALIZED (SELECT k, i, x FROM s JOIN p USING (r))",
    ]
    for j in range(ROUNDS + 1):
        parts.append(f"d{j} AS (SELECT r, k, CAST(sum((p.x - c.x) * (p.x - c.x)) AS BIGINT) AS d FROM p JOIN c{j} c USING (i) GROUP BY ALL)")
        parts.append(f"a{j} AS MATERIALIZED (SELECT r, k, d FROM d{j} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)")
        if j < ROUNDS:
            parts.append(f"m{j} AS (SELECT k, i, CAST(sum(x) AS BIGINT) AS t, count(*) AS n FROM a{j} JOIN p USING (r) GROUP BY ALL)")
            parts.append(f"c{j + 1} AS MATERIALIZED (SELECT c.k, c.i, coalesce((t - (t % n + n) % n) // n, c.x) AS x FROM c{j} c LEFT JOIN m{j} USING (k, i))")
    parts.append(f"h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY k)")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{ROUNDS} JOIN v USING (r) JOIN h USING (k)"""


OP11_SQL = _sql()
