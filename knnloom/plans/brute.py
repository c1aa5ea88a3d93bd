"""All pairs, then the k best of each input point."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.allpairs import nested_states
from ..operators.states import ranked


def brute(queries: DataFrame, candidates: DataFrame, k: int, n_input: int | None = None, **_: object) -> DataFrame:
    """Nested loop by blocks, in tasks that keep the k best of their points; pairs are never rows.

    ``n_input``: how many points there are, where that is known.
    """
    return ranked(nested_states(queries, candidates, k, n_input))
