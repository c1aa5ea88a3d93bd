"""Stored candidates: any point set, no shuffle of candidates, only the bands in reach."""

import numpy as np
import pytest

from knnloom.plans import stored as stored_module
from knnloom.plans import sweep as sweep_module
from knnloom.plans.stored import open_candidates, store_candidates, stored_join

from .test_join import CASES, RNG, expected, frame, want


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("case", ["clustered", "long run of equal y", "far from the unit square", "fewer than k", "crowd at one place", "sparse stripes"])
def test_equals_nested_loop(spark, tmp_path, monkeypatch, case):
    monkeypatch.setattr(sweep_module, "TILE_ROWS", 24)
    q, t, k, options = CASES[case]
    store_candidates(frame(spark, t), str(tmp_path / "t"), k, buckets=3, **options)
    got = open_candidates(spark, str(tmp_path / "t"))
    assert rows(stored_join(frame(spark, q), got, k)) == want(q, t, k)
    assert rows(stored_join(frame(spark, q), got, 1)) == want(q, t, 1)
    monkeypatch.setattr(sweep_module, "MOST_POINTS", 10)  # hot tiles
    assert rows(stored_join(frame(spark, q), got, k)) == want(q, t, k)


def test_second_join_reads_the_table_without_a_shuffle_and_few_bands(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sweep_module, "TILE_ROWS", 64)
    t = RNG.random((3000, 2))
    path = str(tmp_path / "t")
    store_candidates(frame(spark, t), path, 5, bands=16, buckets=4)
    files = sorted(tmp_path.rglob("*.parquet"))
    got = open_candidates(spark, path)
    for low, most in ((0.5, 4), (0.0, 16)):
        q = np.c_[RNG.random(60), low + 0.01 * RNG.random(60) if low else RNG.random(60)]
        points = frame(spark, q)
        assert rows(stored_join(points, got, 5)) == expected((range(1, 61), q), (range(1, 3001), t), 5)
        asked = sweep_module._located(sweep_module._points(points), got.tiles.grid).selectExpr("block tile", "id input_id", "v", "u")
        read = stored_module.sides_of(got, asked)
        joined = read[0].cogroup(read[1]).applyInArrow(sweep_module._asked_only(lambda key, a, b: b.slice(0, 1).select(["tile"])), "tile int")
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")
        assert plan[0].count("Exchange hashpartitioning(tile") == 1 and "Bucketed: true" in plan[0]  # that of the points
        assert "dynamicpruning" in plan[1]
        bands = stored_module.band_of(got.tiles.boxes.stripe, len(got.tiles.grid.blocks), got.bands)
        touched = {int(bands[np.searchsorted(got.tiles.boxes.block, r["tile"])]) for r in asked.select("tile").distinct().collect() if r["tile"] in got.tiles.boxes.block}
        assert len(touched) <= most
    assert sorted(tmp_path.rglob("*.parquet")) == files


def test_k_and_empty_tables(spark, tmp_path):
    store_candidates(frame(spark, []), str(tmp_path / "none"), 3)
    none = open_candidates(spark, str(tmp_path / "none"))
    assert none is None and stored_join(frame(spark, [(0, 0)]), none, 3).count() == 0
    store_candidates(frame(spark, [(0, 0), (1, 1)]), str(tmp_path / "two"), 3)
    two = open_candidates(spark, str(tmp_path / "two"))
    assert stored_join(frame(spark, []), two, 3).count() == 0
    for k in (0, 4):
        with pytest.raises(ValueError):
            stored_join(frame(spark, [(0, 0)]), two, k)
