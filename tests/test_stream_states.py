"""The stream of candidates: states against the batch join, restart, crowds, routes."""

import numpy as np
import pandas as pd
import pytest

from knnloom.streaming import current, nearest, prepare, start, updates

from .test_join import RNG, expected, frame


def stream(spark, tmp_path, files=1):
    arriving = spark.readStream.schema("id bigint, x double, y double").option("maxFilesPerTrigger", files).parquet(str(tmp_path / "in"))
    changed = updates(spark, str(tmp_path / "seeds"), arriving)
    sink = lambda df, batch: df.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={batch}"))
    start(changed, sink, str(tmp_path / "checkpoint")).awaitTermination()


def result(spark, tmp_path):
    return sorted(map(tuple, current(spark, str(tmp_path / "seeds"), spark.read.parquet(str(tmp_path / "out"))).collect()))


@pytest.mark.parametrize("known", [100, 0])
def test_equals_the_batch_join_also_after_a_restart(spark, tmp_path, monkeypatch, known):
    monkeypatch.setattr(nearest, "TILE_POINTS", 16)
    q = np.r_[RNG.random((60, 2)), np.full((50, 2), 0.25)]  # a crowd
    t = np.round(RNG.random((400, 2)), 2)  # ties
    candidates = frame(spark, t)
    prepare(frame(spark, q), candidates.where(f"id <= {known}"), 4, str(tmp_path / "seeds"))
    assert spark.read.parquet(str(tmp_path / "seeds/boxes")).count() >= 5
    candidates.where(f"id > {known} and id <= 250").repartition(2).write.parquet(str(tmp_path / "in"))
    stream(spark, tmp_path)
    assert result(spark, tmp_path) == expected((range(1, 111), q), (range(1, 251), t[:250]), 4)
    candidates.where("id > 250").union(spark.createDataFrame([(999, float("nan"), 0.5)], "id bigint, x double, y double")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream(spark, tmp_path)  # from the checkpoint, with the state as it was
    assert result(spark, tmp_path) == expected((range(1, 111), q), (range(1, 401), t), 4)


def test_routes_are_all_boxes_in_reach():
    rng = np.random.default_rng(5)
    for n in (0, 1, 40):
        low = rng.random((n, 2))
        reach = np.where(rng.random(n) < 0.1, np.inf, rng.random(n) * 0.02)
        boxes = pd.DataFrame({"tile": np.arange(n), "v0": low[:, 0], "u0": low[:, 1], "v1": low[:, 0] + 0.1, "u1": low[:, 1] + 0.1, "reach": reach})
        v, u = rng.random((2, 200)) * 1.4 - 0.2
        gap = [np.maximum(np.maximum(low[:, a] - x[:, None], x[:, None] - low[:, a] - 0.1), 0) for a, x in enumerate((v, u))]
        want = np.argwhere(gap[0] ** 2 + gap[1] ** 2 <= reach)
        assert sorted(zip(*(x.tolist() for x in nearest.Routes(boxes).of(v, u)), strict=True)) == [tuple(r) for r in want.tolist()]


def test_state_has_partitions_for_its_tiles_and_seeds_leave_no_tables(spark, tmp_path, monkeypatch):
    from knnloom.sources import kept_tables

    monkeypatch.setattr(nearest, "TILE_POINTS", 16)
    before = spark.conf.get("spark.sql.shuffle.partitions"), kept_tables()
    q, t = RNG.random((2000, 2)), RNG.random((400, 2))
    candidates, seen = frame(spark, t), []
    prepare(frame(spark, q), candidates.where("id <= 100"), 4, str(tmp_path / "seeds"))
    assert kept_tables() == before[1]
    tiles = spark.read.parquet(str(tmp_path / "seeds/boxes")).count()
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert nearest.state_partitions(spark, str(tmp_path / "seeds")) == max(8, -(-tiles // nearest.SHARED_TILES)) < 40
        candidates.where("id > 100").repartition(2).write.parquet(str(tmp_path / "in"))
        arriving = spark.readStream.schema("id bigint, x double, y double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = start(updates(spark, str(tmp_path / "seeds"), arriving), lambda df, batch: df.write.parquet(str(tmp_path / f"out/batch={batch}")), str(tmp_path / "checkpoint"), str(tmp_path / "seeds"))
        query.awaitTermination()
        seen = [p["stateOperators"][0]["numShufflePartitions"] for p in (x if isinstance(x, dict) else __import__("json").loads(x.json) for x in query.recentProgress) if p["stateOperators"]]
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
    assert set(seen) == {max(8, -(-tiles // nearest.SHARED_TILES))}
    assert result(spark, tmp_path) == expected((range(1, 2001), q), (range(1, 401), t), 4)
