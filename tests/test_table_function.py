"""The join as a table function of SQL."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from knnloom.plans import sweep
from knnloom.plans.table_function import create_aknn

from .test_join import RNG, expected, frame


def called(spark, k, name="aknn"):
    return sorted(map(tuple, spark.sql(f"SELECT * FROM {name}({k})").collect()))


def test_equals_brute_force_for_each_k_up_to_the_most(spark, monkeypatch):
    monkeypatch.setattr(sweep, "TILE_ROWS", 60)
    q, t = RNG.random((300, 2)), np.round(RNG.random((900, 2)), 2)  # ties
    create_aknn(spark, frame(spark, q), frame(spark, t), 7)
    for k in (1, 4, 7):
        assert called(spark, k) == expected((range(1, 301), q), (range(1, 901), t), k)
    for k in (0, 8):
        with pytest.raises(PySparkException):
            called(spark, k)


def test_crowds_of_points_are_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(sweep, "TILE_ROWS", 60)
    monkeypatch.setattr(sweep, "MOST_POINTS", 50)
    q = np.r_[np.full((400, 2), 0.5), RNG.random((40, 2))]
    t = RNG.random((600, 2))
    create_aknn(spark, frame(spark, q), frame(spark, t), 3, "crowd")
    assert called(spark, 3, "crowd") == expected((range(1, 441), q), (range(1, 601), t), 3)
    sizes = spark.sql("SELECT count(*) AS n FROM crowd_rows WHERE input_id IS NOT NULL GROUP BY tile, part").collect()
    assert len(sizes) >= 8 and max(r["n"] for r in sizes) < 150


def test_few_none_and_odd_points(spark):
    q = frame(spark, [[0.1, 0.1], [float("nan"), 1.0], [5.0, -3.0]])
    none = frame(spark, RNG.random((1, 2))).limit(0)
    create_aknn(spark, q, none, 4, "nobody")
    assert called(spark, 2, "nobody") == []
    t = np.array([[0.0, 0.0], [1.0, 1.0]])
    create_aknn(spark, q, frame(spark, t), 4, "few")
    assert called(spark, 4, "few") == expected(([1, 3], np.array([[0.1, 0.1], [5.0, -3.0]])), ([1, 2], t), 4)
    create_aknn(spark, none, frame(spark, t), 4, "few")  # made anew
    assert called(spark, 4, "few") == []
    with pytest.raises(ValueError):
        create_aknn(spark, q, none, 4, "no name")
