"""Mergeable bounded states of the join: a point's k nearest so far.

A state is (input_id, ids, far): neighbours and their squared distances, nearest
first and by id at equal distance, k at most.  States of disjoint candidates
merge in any order.  ``nearest_states`` makes them from single candidates: each
task keeps k for a point, so what is shuffled is at most k a point and task, and
all candidates of a point are never sorted together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "input_id bigint, ids array<bigint>, far array<double>"
#: Candidates that a task holds before it lets go of all but k of each point.
HELD = 1 << 20


def best(owner: np.ndarray, far: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of each owner's k nearest, in order of owner, distance and id."""
    order = np.lexsort((ids, far, owner))
    o = owner[order]
    first = np.flatnonzero(np.r_[True, o[1:] != o[:-1]]) if len(o) else np.empty(0, np.int64)
    rank = np.arange(len(o)) - np.repeat(first, np.diff(np.r_[first, len(o)]))
    return order[rank < k]


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list for each size, of the values in turn."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values, kind))


def state_batch(owner: np.ndarray, far: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """States from what ``best`` gives."""
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[first, len(owner)])
    return pa.RecordBatch.from_arrays([pa.array(owner[first], pa.int64()), lists(ids, sizes, pa.int64()), lists(far, sizes, pa.float64())], ["input_id", "ids", "far"])


def partial_states(k: int):
    """Batches of (input_id, neighbor_id, dist_sq) to states, several for a point at worst."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def reduced() -> tuple[np.ndarray, ...]:
            owner, ids, far = (np.concatenate(c) for c in zip(*held, strict=True))
            keep = best(owner, far, ids, k)
            return owner[keep], ids[keep], far[keep]

        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)))
            size += batch.num_rows
            if size > HELD:
                held = [reduced()]
                size = len(held[0][0])
                if size > HELD // 2:  # too many points to hold
                    yield state_batch(held[0][0], held[0][2], held[0][1])
                    held, size = [], 0
        if held:
            owner, ids, far = reduced()
            yield state_batch(owner, far, ids)

    return made


def merge_states(states: DataFrame, k: int) -> DataFrame:
    """One state for each point: the k nearest over all its states."""
    pairs = F.arrays_zip(F.col("far"), F.col("ids"))
    near = states.groupBy("input_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list(pairs))), 1, k).alias("near"))
    return near.select("input_id", F.col("near")["ids"].alias("ids"), F.col("near")["far"].alias("far"))


def nearest_states(candidates: DataFrame, k: int, tasks: int | None = None) -> DataFrame:
    """The states of (input_id, neighbor_id, dist_sq); ``tasks``: how many merge them (by default as the session has it)."""
    rows = candidates.where("neighbor_id is not null").select("input_id", "neighbor_id", F.col("dist_sq").cast("double"))
    states = rows.mapInArrow(partial_states(k), STATE)
    return merge_states(states.repartition(tasks, "input_id") if tasks else states, k)


def ranked(states: DataFrame) -> DataFrame:
    """The join's rows (input_id, rnk, neighbor_id, dist_sq)."""
    one = states.select("input_id", F.posexplode(F.arrays_zip(F.col("ids"), F.col("far"))).alias("place", "near"))
    return one.select("input_id", (F.col("place") + 1).cast("bigint").alias("rnk"), F.col("near")["ids"].alias("neighbor_id"), F.col("near")["far"].alias("dist_sq"))
