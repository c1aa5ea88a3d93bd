"""Distances and the size rule, as Catalyst expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dist_sq(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Squared Euclidean distance, as products so that every engine rounds alike."""
    dx, dy = bx - ax, by - ay
    return dx * dx + dy * dy


def finite_points(df: DataFrame) -> DataFrame:
    """(id, x, y) without rows whose coordinates are null, NaN or infinite."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return df.select(F.col("id").cast("bigint").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(ok("x") & ok("y"))


def optimal_stripes(n_training: int, k: int) -> int:
    """Square root of training points per neighbour asked for; 1 at least."""
    return max(1, math.floor(math.sqrt(n_training) / math.sqrt(k) + 0.5))
