"""Operators over join results (input_id, rnk, neighbor_id, dist_sq)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .states import nearest_states, ranked


def top_k(candidates: DataFrame, k: int) -> DataFrame:
    """The k nearest of (input_id, neighbor_id, dist_sq), ranked from 1; ties go to the smaller id.

    Catalyst limits each group before the shuffle as well as after it.
    """
    order = Window.partitionBy("input_id").orderBy("dist_sq", "neighbor_id")
    ranked = candidates.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= k)
    return ranked.select("input_id", F.col("rnk").cast("bigint").alias("rnk"), "neighbor_id", "dist_sq")


#: Neighbours that one task merges, at most about.
MERGED = 1 << 21


def merge(parts: list[DataFrame], k: int, points: int | None = None) -> DataFrame:
    """The k nearest over several results for the same points and disjoint candidates.

    ``points``: how many there are; the tasks that merge then grow in number with
    them and not in size, whatever the session's partitions are.
    """
    tasks = None
    if points is not None:
        tasks = max(parts[0].sparkSession.sparkContext.defaultParallelism, -(-points * k * len(parts) // MERGED))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return ranked(nearest_states(union.select("input_id", "neighbor_id", "dist_sq"), k, tasks))


def positions(result: DataFrame, k: int) -> DataFrame:
    """The result with ``position``: 0 for the farthest of the k slots."""
    return result.select("input_id", (F.lit(k).cast("bigint") - F.col("rnk")).alias("position"), "neighbor_id", "dist_sq")


def nested(result: DataFrame) -> DataFrame:
    """(input_id, neighbors): one row a point, neighbours nearest first."""
    lists = result.groupBy("input_id").agg(F.array_sort(F.collect_list(F.struct("rnk", "neighbor_id", "dist_sq"))).alias("neighbors"))
    return lists.select("input_id", F.transform("neighbors", lambda n: F.struct(n["neighbor_id"].alias("neighbor_id"), n["dist_sq"].alias("dist_sq"))).alias("neighbors"))


#: Fixed value: what an empty slot's distance is written as, the largest double.
EMPTY_SLOT = 1.7976931348623157e308


@F.arrow_udf(StringType())
def short_number(value: pa.Array) -> pa.Array:
    """A number of six significant digits, as C writes it; Java's rounding of ties differs, so not by its formatter."""
    return pa.array([None if v is None else f"{v:g}" for v in value.to_pylist()], pa.string())


def result_lines(result: DataFrame, full: bool = False) -> DataFrame:
    """(input_id, line): ``id<TAB>(neighbor distance)...``, farthest first; empty slots are NULL, at the largest distance.

    Distances have six significant digits, or all if ``full``.
    """
    far = F.coalesce("n.dist_sq", F.lit(EMPTY_SLOT))
    number = far.cast("string") if full else short_number(far)
    one = F.concat(F.lit("("), F.coalesce(F.col("n.neighbor_id").cast("string"), F.lit("NULL")), F.lit(" "), number, F.lit(")"))
    parts = result.select("input_id", "rnk", F.struct("neighbor_id", "dist_sq").alias("n")).select("input_id", F.struct((-F.col("rnk")).alias("o"), one.alias("s")).alias("p"))
    lists = parts.groupBy("input_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return lists.select("input_id", F.concat_ws("\t", F.col("input_id").cast("string"), F.transform("ps", lambda p: p["s"])).alias("line"))


def difference_ids(left: DataFrame, right: DataFrame, accuracy: float = 1e-15) -> DataFrame:
    """Ids whose distances differ at some rank by more than ``accuracy``, or that one side lacks there."""
    a = left.select("input_id", "rnk", F.col("dist_sq").alias("a"), F.lit(True).alias("in_a"))
    b = right.select("input_id", "rnk", F.col("dist_sq").alias("b"), F.lit(True).alias("in_b"))
    both = a.join(b, ["input_id", "rnk"], "full_outer")
    off = F.col("in_a").isNull() | F.col("in_b").isNull() | (F.col("a").isNull() != F.col("b").isNull()) | (F.abs(F.col("a") - F.col("b")) > accuracy)
    return both.where(off).select("input_id").distinct()


def first_differences(left: DataFrame, right: DataFrame, accuracy: float = 1e-15, n: int = 5) -> DataFrame:
    """The n smallest ids of ``difference_ids``."""
    return difference_ids(left, right, accuracy).orderBy("input_id").limit(n)
