"""Writers of join results and run metrics."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.results import result_lines


def result_name(prefix: str, seconds: float) -> str:
    """The name of a result: prefix, time of day, and how long it took in milliseconds."""
    return f"{prefix}_{time.strftime('%Y%m%d%H%M%S')}_{round(1000 * seconds)}"


def write_neighbours(result: DataFrame, path: str, ordered: bool = True, full: bool = False, places: DataFrame | None = None) -> None:
    """One text line a point, farthest neighbour first; by id if ``ordered``, with all digits if ``full``.

    ``places`` (id, place), as ``read_tokens`` gives them, puts the lines in the order of the points' file.
    """
    lines = result_lines(result, full)
    if places is not None:
        lines = lines.join(places.select(F.col("id").alias("input_id"), "place"), "input_id")
    (lines.orderBy("place" if places is not None else "input_id") if ordered else lines).select("line").write.text(path)


#: The headings of the metrics file.
HEADINGS = (
    "Algorithm;Total Duration;Sorting Duration;Total Heap Additions;Min. Heap Additions;Max. Heap Additions;Avg. Heap Additions;NumberOfStripes;"
    "HasAllocationError;PendingPoints;NumFirstPassWindows;NumSecondPassWindows;CommitWindow Duration;Final Sorting Duration;Differences;First 5 different point ids"
).split(";")


def write_metrics(metrics: DataFrame, path: str, localised: bool = False) -> None:
    """A run's metrics as CSV with semicolons; ``localised``: decimal commas.

    All sixteen columns get the file's headings; candidates ranked stand under heap additions.
    """
    if len(metrics.columns) == len(HEADINGS):
        metrics = metrics.toDF(*HEADINGS)
    if localised:
        comma = lambda c: F.translate(F.format_number(F.col(f"`{c}`"), 6), ".,", ",.").alias(c)
        metrics = metrics.select(*(comma(c) if t == "double" else F.col(f"`{c}`") for c, t in metrics.dtypes))
    metrics.coalesce(1).write.csv(path, sep=";", header=True)


def write_stripes(stats: DataFrame, path: str) -> None:
    """Stripe statistics as CSV with semicolons."""
    names = {"stripe": "StripeId", "min_y": "MinY", "max_y": "MaxY", "n_input": "InputPoints", "n_training": "TrainingPoints"}
    stats.orderBy("stripe").select(*(F.col(c).alias(n) for c, n in names.items())).write.csv(path, sep=";", header=True)
