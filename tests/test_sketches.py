"""Quantile sketches: depth within the stated bound, merging of parts, and reuse for another set."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from knnloom.operators import boundaries, sketches, stripe_depths
from knnloom.operators.sketches import merged, rank_error
from knnloom.plans.stored import open_candidates, store_candidates, stored_join

from .test_join import RNG, expected, frame


@pytest.mark.parametrize("size", [200, 4096])
def test_depth_of_stripes(spark, size):
    n, parts = 60_000, 25
    points = spark.range(n).select("id", F.pow(F.rand(3), 5.0).alias("y"), F.lit(0.0).alias("x")).repartition(6).persist()
    made = sketches(points, by=F.spark_partition_id().cast("string"), size=size)
    assert made.count() == 6
    depths = [r["n"] for r in stripe_depths(points, boundaries(made, parts, size)).collect()]
    assert len(depths) == parts and sum(depths) == n
    assert max(abs(d - n / parts) for d in depths) <= 2 * rank_error(size) * n + 1
    points.unpersist()


def test_few_points_equal_values_and_none(spark):
    points = frame(spark, [(0, 1), (0, 2), (0, 2), (0, 2), (0, 9)])
    assert boundaries(sketches(points), 1).tolist() == []
    assert set(boundaries(sketches(points), 4).tolist()) <= {1.0, 2.0, 9.0}
    none = sketches(points.where("false"))
    assert boundaries(none, 5).tolist() == [] and merged(none).first()["n"] == 0


def test_sketches_of_one_set_cut_another(spark, tmp_path):
    q, t = RNG.random((30, 2)), RNG.random((400, 2))
    sketches(frame(spark, q)).write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    store_candidates(frame(spark, t), str(tmp_path / "t"), 4, stripes=5, sketched=stored)
    got = open_candidates(spark, str(tmp_path / "t"))
    assert np.array_equal(got.tiles.grid.stripes, boundaries(stored, 5))
    assert sorted(map(tuple, stored_join(frame(spark, q), got, 4).collect())) == expected((range(1, 31), q), (range(1, 401), t), 4)
