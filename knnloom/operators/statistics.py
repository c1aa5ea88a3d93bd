"""Counts and cost metrics of a run."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dist_sq


def dataset_counts(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(n_input, n_training), one row."""
    a, b = queries.agg(F.count("*").alias("n_input")), candidates.agg(F.count("*").alias("n_training"))
    return a.join(b)


def pairs(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """All pairs (input_id, neighbor_id, dist_sq): the nested loop."""
    q = queries.select(F.col("id").alias("input_id"), F.col("x").alias("ix"), F.col("y").alias("iy"))
    t = candidates.select(F.col("id").alias("neighbor_id"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    return q.crossJoin(t).select("input_id", "neighbor_id", dist_sq(F.col("ix"), F.col("iy"), F.col("tx"), F.col("ty")).alias("dist_sq"))


def candidate_stats(candidates: DataFrame, column: str = "n") -> DataFrame:
    """Total, least, most and mean of a count for each input point."""
    return candidates.agg(
        F.sum(column).cast("bigint").alias("total"), F.min(column).cast("bigint").alias("least"), F.max(column).cast("bigint").alias("most"), F.avg(column).alias("mean"),
    )


def candidate_counts(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(input_id, n): how many candidates are ranked for each input point, 0 included."""
    counts = rows.groupBy("input_id").agg(F.count("*").alias("n"))
    return queries.select(F.col("id").alias("input_id")).join(counts, "input_id", "left").select("input_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


#: Columns of the metrics of a run.  Sorting is what is done before the join's own action: boundaries, boxes and round one
#: where it is a table; its tasks are the first pass, those of the action the second.  Commit is the time that ``save`` took,
#: the final sort that of putting the result in order of point and rank.
METRICS = (
    "strategy string, total_seconds double, sorting_seconds double, candidates_total bigint, candidates_least bigint, candidates_most bigint, candidates_mean double, stripes bigint, "
    "allocation_error boolean, pending_points bigint, first_pass_windows bigint, second_pass_windows bigint, commit_seconds double, final_sort_seconds double, differences bigint, first_ids string"
)


@dataclass
class Timing:
    seconds: float = 0.0
    tasks: int = 0


@contextmanager
def _timed(spark: SparkSession, name: str) -> Iterator[Timing]:
    """Measures what runs inside: seconds, and tasks that its jobs completed."""
    out, context, group = Timing(), spark.sparkContext, f"knnloom-{uuid.uuid4().hex}"
    context.setJobGroup(group, name)
    began = time.perf_counter()
    try:
        yield out
    finally:
        out.seconds = time.perf_counter() - began
        for key in ("spark.jobGroup.id", "spark.job.description"):
            context.setLocalProperty(key, None)
    tracker = context.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
    stages = [tracker.getStageInfo(s) for s in {s for j in jobs if j for s in j.stageIds}]
    out.tasks = sum(s.numCompletedTasks for s in stages if s)


def all_counts(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(input_id, n) of the nested loop: it ranks every candidate for each input point."""
    return queries.select(F.col("id").alias("input_id")).crossJoin(F.broadcast(candidates.agg(F.count("*").alias("n"))))


def run_metrics(
    names: list[str], queries: DataFrame, candidates: DataFrame, k: int, accuracy: float = 1e-15, compare: bool = True, count: bool = True, pad: bool = False, save: Callable[[str, DataFrame, float], None] | None = None, **options: object,
) -> DataFrame:
    """Runs several strategies and compares each with the first; one row of METRICS a strategy.

    ``compare`` and ``count`` switch the comparison and the candidate counts; strategies of
    one's own have no such counts.  A strategy is planned once, and its result is a table of its own.
    Tasks are those that Spark's status tracker still knows.  ``save`` gets each strategy's name, result and seconds.
    """
    from ..functions import finite_points, optimal_stripes
    from ..plans import with_counts
    from ..sources.scratch import kept
    from .join import aknn_join, with_padding
    from .results import difference_ids

    if k < 1:
        raise ValueError("k must be at least 1")
    spark, first, rows = queries.sparkSession, None, []
    points, known = finite_points(queries), finite_points(candidates)
    stripes = options.get("stripes") or optimal_stripes(candidates.count(), k)
    for name in names:
        more = options | ({"n_input": points.count()} if name == "brute" else {})  # its one size, which is no sorting
        with _timed(spark, name) as sorting:
            plan, counts = with_counts(name, points, known, k, **more) if count else (aknn_join(points, known, k, name, **more), None)
        with _timed(spark, name) as action:
            got = kept(with_padding(plan, points, k) if pad else plan)
        seconds = sorting.seconds + action.seconds
        with _timed(spark, name) as commit:
            if save:
                save(name, got, seconds)
        with _timed(spark, name) as ordering:
            got.orderBy("input_id", "rnk").write.format("noop").mode("overwrite").save()
        stats = candidate_stats(counts).first() if counts is not None else (None,) * 4
        different, ids = (0, "") if compare else (None, None)  # the first is like itself
        if compare and first is not None:
            off = kept(difference_ids(first, got, accuracy))
            different, ids = off.count(), ", ".join(str(r[0]) for r in off.orderBy("input_id").limit(5).collect())
        first = first or got
        rows.append((name, seconds, sorting.seconds, *stats, None if name == "brute" else stripes, False, 0, sorting.tasks, action.tasks, commit.seconds, ordering.seconds, different, ids))
    return spark.createDataFrame(rows, METRICS)
