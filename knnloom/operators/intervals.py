"""Overlap join of intervals, and of points with the intervals that hold them.

Intervals are half-open, [start, end); one whose ends are equal is a point.  Two of
them meet if the larger start lies in both.  Lengths go by powers of two, and an
interval is on the level of its own: there it touches two buckets at most.  A pair
is found on the higher of its two levels, so each row goes to its level and to those
higher ones that the other side has, not to every bucket that a long interval
crosses.  The pair belongs to the bucket that holds the larger start, where both
rows are, so it is found once.  That is an equi-join, never a nested loop.

Where a bucket has more than MOST_ROWS rows of the right side, those are dealt to
parts by a hash of their columns, and the left side's rows of it go to each part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the right side in one group of the join.
MOST_ROWS = 100_000


def _level(start: Column, end: Column) -> Column:
    """The power of two that is about as long; points are on the lowest, -1074."""
    return F.when(end > start, F.ceil(F.log2(end - start))).otherwise(-1074).cast("int")


def _held(start: Column, end: Column, at: Column) -> Column:
    return (start <= at) & (at < end) | (start == end) & (start == at)


def _spread(rows: DataFrame, others: list[int], unit: int) -> DataFrame:
    """The rows in each of their buckets (on, bucket), on levels of their own and of the other side."""
    levels = F.array(*map(F.lit, others)) if others else F.array().cast("array<int>")
    on = F.array_distinct(F.filter(F.concat(F.array("__level"), levels), lambda m: m >= F.col("__level")))
    wide = rows.withColumn("__on", F.explode(on))
    width = F.pow(F.lit(2.0), F.greatest("__on", F.lit(unit)))
    first, last = F.floor(F.col("__start") / width), F.floor(F.col("__end") / width)
    return wide.withColumn("__first", first).withColumn("__bucket", F.explode(F.sequence(first, last)))


def overlap_join(left: DataFrame, right: DataFrame, left_on: tuple[str, str], right_on: tuple[str, str]) -> DataFrame:
    """All pairs of rows whose intervals meet, with the columns of both sides; names must differ.

    Ends are numbers (compared as doubles).  Rows with a null, NaN or infinite end,
    or that end before they start, meet nothing.
    """
    both = set(left.columns) & set(right.columns)
    if both:
        raise ValueError(f"both sides have {sorted(both)}")

    def made(df: DataFrame, on: tuple[str, str]) -> DataFrame:
        start, end = (F.col(f"`{c}`").cast("double") for c in on)
        rows = df.withColumns({"__start": start, "__end": end})
        fine = (F.abs("__start") < float("inf")) & (F.abs("__end") < float("inf")) & (F.col("__start") <= F.col("__end"))
        return rows.where(fine).withColumn("__level", _level(F.col("__start"), F.col("__end")))

    a, b = made(left, left_on), made(right, right_on)
    # some 2000 levels exist, and few are used: those of both sides come to the driver
    used = [sorted(r[0] for r in x.select("__level").distinct().collect()) for x in (a, b)]
    largest = max((r[0] for x in (a, b) if (r := x.agg(F.max(F.greatest(F.abs("__start"), F.abs("__end")))).first())[0] is not None), default=0.0)
    unit = max(-1022, math.frexp(largest)[1] - 53)  # finer buckets than doubles tell apart serve nothing
    a, b = _spread(a, used[1], unit), _spread(b, used[0], unit)
    keys = ["__on", "__bucket"]
    parts = b.groupBy(*keys).count().where(F.col("count") > MOST_ROWS).select(*keys, F.ceil(F.col("count") / MOST_ROWS).cast("int").alias("__parts"))
    if parts.limit(1).count():
        n = F.coalesce("__parts", F.lit(1))
        a = a.join(parts, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), n - 1))).drop("__parts")
        told = [f"`{f.name}`" for f in right.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
        b = b.join(parts, keys, "left").withColumn("__part", F.pmod(F.xxhash64(*told), n).cast("int")).drop("__parts")
        keys.append("__part")
    mine = a.select(*keys, *(F.col(f"`{c}`") for c in left.columns), *(F.col(f"__{c}").alias(f"__l{c}") for c in ("start", "end", "level", "first")))
    theirs = b.select(*keys, *(F.col(f"`{c}`") for c in right.columns), *(F.col(f"__{c}").alias(f"__r{c}") for c in ("start", "end", "level", "first")))
    at = F.greatest("__lstart", "__rstart")
    once = (F.greatest("__llevel", "__rlevel") == F.col("__on")) & (F.greatest("__lfirst", "__rfirst") == F.col("__bucket"))
    met = mine.join(theirs, keys).where(once & _held(F.col("__lstart"), F.col("__lend"), at) & _held(F.col("__rstart"), F.col("__rend"), at))
    return met.select(*(F.col(f"`{c}`") for c in left.columns), *(F.col(f"`{c}`") for c in right.columns))
