"""The stream of points: candidates are stored once, batches leave no tables."""

import numpy as np
import pytest

from knnloom.sources import kept_tables
from knnloom.streaming import lookup, stream_aknn

from .test_join import RNG, expected, frame


@pytest.mark.parametrize("strategy", ["auto", "sweep"])
def test_batches_equal_the_whole_and_leave_nothing(spark, tmp_path, monkeypatch, strategy):
    q, t = RNG.random((40, 2)), RNG.random((500, 2))
    stores = []
    monkeypatch.setattr(lookup, "store_candidates", lambda *a, f=lookup.store_candidates: stores.append(f(*a)))
    points, got, tables = frame(spark, q), [], []
    points.where("id <= 25").coalesce(1).write.parquet(str(tmp_path / "in"))

    def sink(result, batch_id):
        got.extend(map(tuple, result.collect()))
        tables.append(kept_tables())

    def run():
        stream = spark.readStream.schema("id bigint, x double, y double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream_aknn(stream, frame(spark, t), 3, sink, str(tmp_path / "checkpoint"), strategy).awaitTermination()

    before = kept_tables()
    run()
    points.where("id > 25").repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
    run()  # from the checkpoint
    assert sorted(got) == expected((range(1, 41), q), (range(1, 501), t), 3)
    assert len(tables) >= 3 and kept_tables() == before and len(stores) == (2 if strategy == "auto" else 0)
    assert np.isfinite([r[3] for r in got]).all()
