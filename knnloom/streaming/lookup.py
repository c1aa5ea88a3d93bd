"""Each micro-batch is joined by the batch operator; an extension beside the batch join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import aknn_join
from ..plans.stored import open_candidates, store_candidates, stored_join
from ..sources import drop_kept, kept_tables, scratch


def stream_aknn(points: DataFrame, candidates: DataFrame, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str, strategy: str = "auto", **trigger: object) -> StreamingQuery:
    """Starts a query that hands each batch's neighbours to ``sink(result, batch_id)``.

    By ``auto`` the candidates are stored in tiles once, before the first batch, and
    each batch reads the bands in its reach.  Other strategies plan each batch anew.
    Tables that a batch makes go when its sink has returned.
    """
    spark = points.sparkSession
    stored = None
    if strategy == "auto":
        path = scratch(spark)
        store_candidates(candidates, path, k)
        stored = open_candidates(spark, path)

    def each(batch: DataFrame, batch_id: int) -> None:
        first = kept_tables()
        try:
            sink(stored_join(batch, stored, k) if strategy == "auto" else aknn_join(batch, candidates, k, strategy), batch_id)
        finally:
            drop_kept(spark, first)

    return points.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
