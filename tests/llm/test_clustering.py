"""Centroid clustering against a plain loop, its bounds, and odd vectors."""

import hashlib

import numpy as np
import pytest

from knnloom.llm import clustering, queries

from ..conftest import DATA


def plain(rows, k, rounds, width, scale=256, seed=2):
    """{row: (cluster, distance)} and the centroids, by a loop over Python's integers."""
    kept = [(i, v, [max(-clustering.LARGEST, min(clustering.LARGEST, int(np.floor(x * scale)))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), -1 if r[0] is None else r[0], r[2]))
    centroids = [r[2] for r in order[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda q: min((apart(q, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, _, q in kept:
            groups.setdefault(near(q)[1], []).append(q)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centroids)]
    return sorted((i is not None, i or 0, near(q)[1], near(q)[0]) for i, _, q in kept), centroids


def told(rows):
    return sorted((r[0] is not None, r[0] or 0, r[1], r[2]) for r in rows.collect())


def test_query_against_a_plain_loop(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").collect()]
    want, centroids = plain(rows, 40, 5, 64)
    got = queries.QUERIES["op11_clustering"](spark, f"{DATA}/sf0.001").collect()
    assert sorted((True, r["vec_id"], r["cluster"], r["distance"]) for r in got) == want
    sums = {}
    for _, _, c, d in want:
        sums[c] = sums.get(c, 0) + d
    for r in got:
        assert r["cluster_inertia"] == sums[r["cluster"]] and r["inertia"] == sum(sums.values())
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()


def test_compressed_distances_are_lower_bounds_and_save_most_distances():
    rng = np.random.default_rng(3)
    middles = rng.normal(0, 60, (40, 64))
    x = np.floor(middles[rng.integers(0, 40, 3000)] + rng.normal(0, 12, (3000, 64))).astype(np.int64)
    screen = clustering.Screen(np.floor(middles).astype(np.int64))
    short = clustering.compressed(x)
    exact = ((x[:, None] - screen.centroids[None]) ** 2).sum(2)
    bound = ((short[:, None] - screen.short[None]) ** 2).sum(2)
    assert (bound <= exact * (1 + 1e-9) + 1e-6).all()
    at, d = screen.nearest(x, short)
    assert (at == exact.argmin(1)).all() and (d == exact.min(1)).all()
    assert screen.exact < exact.size / 10


def test_ties_and_largest_integers():
    c = np.array([[0, 4], [0, 0], [0, 4], [clustering.LARGEST, -clustering.LARGEST]])
    q = np.array([[0, 2], [0, 4], [-clustering.LARGEST, clustering.LARGEST]])
    at, d = clustering.Screen(c).nearest(q, clustering.compressed(q))
    assert at.tolist() == [0, 0, 0] and d.tolist() == [4, 0, clustering.LARGEST**2 + (clustering.LARGEST - 4) ** 2]


@pytest.mark.parametrize("k", [2, 5, 40])
def test_odd_vectors(spark, k):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, -0.25, 3.0]), (1, [0.5, -0.25, 3.0]), (1, [9.0, 9.0, 9.0]), (2, [0.5, None, 1.0]), (3, [nan, 0.0, 0.0]), (4, [inf, 0.0, 0.0]), (5, None), (6, []), (7, [1.0, 2.0]),
        (None, [-0.001, 0.0, 0.001]), (None, [1.0, 1.0, 1.0]), (8, [1e30, -1e30, 0.0]), (9, [1.0, 2.0, 3.0, 4.0]), (10, [-7.9, 3.2, 0.1]), (11, [9.0, 9.0, 9.0]),
    ]
    frame = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id bigint, embedding array<double>, cluster int, q string").repartition(3)
    want, centroids = plain(rows, k, 5, 3)
    got, final = clustering.clustered(frame, k=k, width=3)
    assert told(got) == want and final.tolist() == centroids
    assert got.columns == ["vec_id", "cluster", "distance"]


def test_empty_table(spark):
    frame = spark.createDataFrame([(1, [1.0])], "vec_id bigint, embedding array<double>")
    got, centroids = clustering.clustered(frame)
    assert got.count() == 0 and not len(centroids) and [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint"]
