"""Named strategies.

Thread runtimes and sort modes of a single-node engine have no counterpart
here, so strategies that differ only in those share a plan.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.states import ranked
from ..operators.statistics import all_counts, candidate_counts, pairs
from .brute import brute
from .sweep import sweep, sweep_states
from .tiles import counted_tiles, reached, tiles


class Strategy(Protocol):
    """A plan of the join: (queries, candidates, k, **options) to (input_id, rnk, neighbor_id, dist_sq)."""

    def __call__(self, queries: DataFrame, candidates: DataFrame, k: int, **options: object) -> DataFrame: ...


FAMILIES: dict[str, Strategy] = {
    "brute": brute,
    "sweep": sweep,
    "sweep_x": partial(tiles, axis="x"),
    "stripes_input": partial(tiles, axis="y", split_by="input"),
    "stripes_training": partial(tiles, axis="y", split_by="training"),
    "grid": partial(tiles, axis="y", by_block=True),
}


def candidate_rows(name: str, queries: DataFrame, candidates: DataFrame, k: int, **options: object) -> DataFrame | None:
    """(input_id, neighbor_id, dist_sq): what a built-in strategy ranks; None for others."""
    plan = strategy(name)
    if plan is brute:
        return pairs(queries, candidates)
    return reached(queries, candidates, k, **plan.keywords, **options) if isinstance(plan, partial) and plan.func is tiles else None


def ranked_counts(name: str, queries: DataFrame, candidates: DataFrame, k: int, **options: object) -> DataFrame | None:
    """(input_id, n): how many candidates a built-in strategy ranks for each point; None for others."""
    if strategy(name) is brute:
        return all_counts(queries, candidates)
    rows = candidate_rows(name, queries, candidates, k, **options)
    return None if rows is None else candidate_counts(rows, queries)


def with_counts(name: str, queries: DataFrame, candidates: DataFrame, k: int, **options: object) -> tuple[DataFrame, DataFrame | None]:
    """The join, and (input_id, n): how many candidates a built-in strategy ranks for each point (``sweep``: distances taken), planned once; None for others."""
    plan, counts = strategy(name), None
    if plan is sweep:
        states, counts = sweep_states(queries, candidates, k, **options)
        result = ranked(states)
    elif isinstance(plan, partial) and plan.func is tiles:
        result, counts = counted_tiles(queries, candidates, k, **plan.keywords, **options)
    else:
        result = plan(queries, candidates, k, **options)
    if counts is None:
        return result, all_counts(queries, candidates) if plan is brute else None
    every = queries.select(F.col("id").alias("input_id")).join(counts, "input_id", "left")
    return result, every.select("input_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def compared(name: str, queries: DataFrame, candidates: DataFrame, k: int, **options: object) -> DataFrame | None:
    """(input_id, n): how many distances a built-in strategy takes for each point (beyond MAX_BLOCKS: ranks); None for others."""
    if strategy(name) is sweep:
        seen = sweep_states(queries, candidates, k, **options)[1]
        return queries.select(F.col("id").alias("input_id")).join(seen, "input_id", "left").select("input_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
    if strategy(name) is brute:
        return all_counts(queries, candidates)
    rows = candidate_rows(name, queries, candidates, k, **options, every=True)
    return None if rows is None else candidate_counts(rows, queries)


#: By place of the 30-digit mask: nested loop serial and on two thread runtimes,
#: sweeps, stripes by input, stripes by training, out-of-core stripes.
_BY_PLACE = ["brute"] * 3 + ["sweep_x"] * 6 + ["stripes_input"] * 9 + ["stripes_training"] * 8 + ["stripes_input", "stripes_training"] * 2
STRATEGIES: dict[int, str] = dict(enumerate(_BY_PLACE))


def strategy(name: str) -> Callable[..., DataFrame]:
    """The plan of that name; ``stripes`` is by training."""
    plan = FAMILIES.get({"stripes": "stripes_training"}.get(name, name))
    if plan is None:
        raise ValueError(f"unknown strategy {name!r}; known: {', '.join(FAMILIES)}")
    return plan


def register(name: str, plan: Strategy) -> None:
    """Adds a strategy of one's own."""
    FAMILIES[name] = plan


def strategy_mask(mask: str) -> list[str]:
    """The strategies that a mask of 0 and 1 selects, each once; short masks are padded with 0."""
    if set(mask) - {"0", "1"} or len(mask) > len(STRATEGIES):
        raise ValueError("a mask has up to 30 digits 0 or 1")
    return list(dict.fromkeys(STRATEGIES[i] for i, c in enumerate(mask) if c == "1"))
