"""Connected components of a distributed edge table.

Alternates large-star and small-star steps (each node's neighbours are linked
to the smallest of them) until nothing changes; every edge then leads to the
smallest node of its component.  Minima are pre-aggregated before the shuffle
and joined back, so a node with very many edges isn't held by one task, and
each step is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import pinned


#: Edges in one file of a step's table, about.
FILE_EDGES = 500_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _step(edges: DataFrame, about: int) -> DataFrame:
    """A step's edges as a table of few files; a step never adds edges to speak of."""
    return pinned(edges.coalesce(max(1, -(-about // FILE_EDGES))), "none")


def _joined(edges: DataFrame, least: DataFrame, many: bool) -> DataFrame:
    """The edges with their node's m; written down where there are many, so that a large node's edges can be split at the join."""
    return edges.join(pinned(least, "none") if many else least, "u")


def _star(both: DataFrame, many: bool) -> DataFrame:
    """Each node's neighbours with the smallest of node and neighbours as m."""
    return _joined(both, both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), many)


def components(edges: DataFrame, about: int, most_steps: int = 100) -> DataFrame:
    """(node, root) for each node that has an edge, from edges (u, v); root is the smallest node.

    ``about``: the number of edges, or a bound; it only sets the number of files.
    Loops and repeated edges don't matter; an empty table gives an empty result.
    """
    now = _step(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), about)
    was = None
    for _ in range(most_steps):
        state = _state(now)
        if state == was or not state[0]:
            break
        was = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        many = state[0] > FILE_EDGES
        large = _star(both, many).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = _joined(down, least, many).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = _step(small.distinct(), state[0])
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
