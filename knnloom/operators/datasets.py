"""Point-set tools: generator, multiplier, thinner, converter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FACTORS = (-2, -1, 1, 2, 4)


def generate_uniform(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """n points with ids 1 to n and x, y uniform in [0, 1): 52 bits of a hash of seed, axis and id, so n and seed say all."""
    draw = lambda axis: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|{axis}|"), F.col("id").cast("string")).cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return spark.range(1, n + 1).select("id", draw("x").alias("x"), draw("y").alias("y"))


def with_place(points: DataFrame, *order: str) -> DataFrame:
    """The points with ``place``, their 0-based rank in an order (by id if none is given).

    Ranks are taken inside ranges of the order, and ranges are offset by the
    counts before them, so no task sorts everything.  Range boundaries come from
    a sample, so the ranged rows are kept: both uses must see the same ranges.
    """
    order = order or ("id",)
    ranged = points.repartitionByRange(*order).withColumn("pid", F.spark_partition_id()).persist()
    counts = ranged.groupBy("pid").agg(F.count("*").alias("n"))
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("pid", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("pid").orderBy(*order)) - 1
    placed = ranged.withColumn("inside", inside).join(F.broadcast(offsets), "pid")
    return placed.select(*points.columns, (F.col("first") + F.col("inside")).cast("bigint").alias("place"))


def target_count(n: int, factor: int) -> int:
    """How many points ``multiply`` makes of n."""
    if factor not in FACTORS:
        raise ValueError(f"factor must be one of {FACTORS}")
    return {-2: (n + 1) // 2, -1: n // 2, 1: n, 2: 4 * (n // 2), 4: 4 * n}[factor]


def multiply(points: DataFrame, factor: int) -> DataFrame:
    """Thins or multiplies, by rank of id from 0; what is kept is numbered anew from 0.

    -1 keeps the odd ranks and -2 the even ones, with ids from 1.  4 copies all
    points and 2 those of odd rank into four quadrants of half size, the copies
    of number j having ids 4j+1 to 4j+4.  1 changes nothing.
    """
    if factor not in FACTORS:
        raise ValueError(f"factor must be one of {FACTORS}")
    if factor == 1:
        return points.select("id", "x", "y")
    placed = with_place(points)
    if factor != 4:
        placed = placed.where(F.col("place") % 2 == (0 if factor == -2 else 1)).withColumn("place", F.floor(F.col("place") / 2))
    if factor < 0:
        return placed.select((F.col("place") + 1).cast("bigint").alias("id"), "x", "y")
    corners = ((0.0, 0.0), (0.0, 0.5), (0.5, 0.0), (0.5, 0.5))
    quadrants = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate(corners, 1)))
    spread = placed.select("*", F.explode(quadrants).alias("q"))
    return spread.select((4 * F.col("place") + F.col("q.i")).cast("bigint").alias("id"), (F.col("x") / 2 + F.col("q.dx")).alias("x"), (F.col("y") / 2 + F.col("q.dy")).alias("y"))


def convert(points: DataFrame) -> DataFrame:
    """Factor 1: the points as they are, for another sink."""
    return multiply(points, 1)
