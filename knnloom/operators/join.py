"""The all-k-nearest-neighbours join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import finite_points

#: Up to this many pairs the nested loop is the plan.
BRUTE_PAIRS = 200_000


def aknn_join(queries: DataFrame, candidates: DataFrame, k: int, strategy: str = "auto", pad: bool = False, **options: object) -> DataFrame:
    """For each point of ``queries`` the k nearest points of ``candidates``.

    Both have (id, x, y) with unique ids.  Returns (input_id, rnk, neighbor_id,
    dist_sq): rnk 1 is the nearest, dist_sq the squared Euclidean distance, ties
    go to the smaller id, and a point is a neighbour of itself where both sets
    hold it.  ``pad`` fills up to k rows with null neighbours.  Points with
    coordinates that aren't finite are left out.
    """
    from ..plans import strategy as named

    if k < 1:
        raise ValueError("k must be at least 1")
    q, t = finite_points(queries), finite_points(candidates)
    if strategy == "auto":
        strategy = "brute" if q.count() * t.count() <= BRUTE_PAIRS else "grid"
    result = named(strategy)(q, t, k, **options)
    return with_padding(result, q, k) if pad else result


def with_padding(result: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exactly k rows for each query point; missing neighbours are null."""
    slots = queries.select(F.col("id").alias("input_id"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(k).cast("bigint"))).alias("rnk"))
    return slots.join(result, ["input_id", "rnk"], "left").select("input_id", "rnk", "neighbor_id", "dist_sq")
