"""Quantile sketches of point sets: made part by part, stored, merged, and asked for stripe boundaries.

A sketch (KLL) holds a few thousand values whatever the number of points, and
sketches of parts merge without the points, so a file that is added costs a pass
over that file alone.  With size K ranks are off by 2.3 / K^0.9 of the points or
less, nearly always; boundaries of ``parts`` stripes are asked for by ranks, so a
stripe holds its share of the points, give or take twice that, and runs of equal values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a sketch; values of 8 bytes, some three times as many.
K = 4096


def rank_error(size: int = K) -> float:
    """The share of the points that a rank may be off by."""
    return 2.3 / size**0.9


def sketches(points: DataFrame, axis: str = "y", by: Column | str | None = None, size: int = K) -> DataFrame:
    """(part, n, sketch): one for each value of ``by``, such as a column of file names, or one of all points."""
    part = F.lit("") if by is None else F.col(by) if isinstance(by, str) else by
    return points.select(part.alias("part"), F.col(axis).cast("double").alias("v")).groupBy("part").agg(F.count("v").alias("n"), F.kll_sketch_agg_double("v", size).alias("sketch"))


def merged(parts: DataFrame, size: int = K) -> DataFrame:
    """(n, sketch), one row, of all parts."""
    return parts.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"), F.kll_merge_agg_double("sketch", size).alias("sketch"))


def boundaries(parts: DataFrame, stripes: int, size: int = K) -> np.ndarray:
    """At most stripes - 1 distinct inner boundaries of about equal depth."""
    if stripes < 2:
        return np.empty(0)
    ranks = F.array(*(F.lit(i / stripes) for i in range(1, stripes)))
    row = merged(parts, size).where("n > 0").select(F.kll_sketch_get_quantile_double("sketch", ranks).alias("q")).first()
    return np.unique(np.array(row["q"], float)) if row else np.empty(0)


def stripe_depths(points: DataFrame, cuts: np.ndarray, axis: str = "y") -> DataFrame:
    """(stripe, n): how many points lie between boundaries, the upper one left out."""
    number = F.arrow_udf(lambda v: pa.array(np.searchsorted(cuts, v.to_numpy(zero_copy_only=False), "right").astype(np.int32)), "int")
    return points.select(number(F.col(axis).cast("double")).alias("stripe")).groupBy("stripe").agg(F.count("*").alias("n"))
