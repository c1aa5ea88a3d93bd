"""The overlap join against all pairs."""

import numpy as np
import pytest

from knnloom.operators import intervals, overlap_join


def frames(spark, a, b):
    return spark.createDataFrame([(i, *x) for i, x in enumerate(a)], "i int, a double, b double"), spark.createDataFrame([(i, *x) for i, x in enumerate(b)], "j int, c double, d double")


def meets(x, y):
    if None in (*x, *y) or not np.isfinite([*x, *y]).all() or x[0] > x[1] or y[0] > y[1]:
        return False
    at = max(x[0], y[0])
    return all(s <= at < e or s == e == at for s, e in (x, y))


def check(spark, a, b):
    left, right = frames(spark, a, b)
    got = sorted((r["i"], r["j"]) for r in overlap_join(left, right, ("a", "b"), ("c", "d")).collect())
    assert got == sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if meets(x, y))
    return len(got)


@pytest.mark.parametrize("most", [100_000, 5])
def test_lengths_of_all_sizes(spark, monkeypatch, most):
    monkeypatch.setattr(intervals, "MOST_ROWS", most)
    rng = np.random.default_rng(9)
    made = lambda n: [(float(s), float(s + w)) for s, w in zip(np.round(rng.normal(0, 50, n), 1), np.round(10.0 ** rng.uniform(-3, 4, n), 3) * (rng.random(n) < 0.9), strict=True)]
    assert check(spark, made(120), made(150)) > 1000


def test_odd_rows(spark):
    odd = [(0.0, 1.0), (1.0, 2.0), (1.0, 1.0), (2.0, 1.0), (None, 1.0), (1.0, None), (float("nan"), 1.0), (0.0, float("inf")), (-1e300, 1e300), (1e-300, 2e-300), (0.0, 0.0), (-0.0, 5e-324), (0.0, 1.0), (1.0, 1.0 + 2**-52), (1e16, 1e16 + 2)]
    check(spark, odd, odd)
    check(spark, odd, [])
    check(spark, [], odd)


def test_long_intervals_are_not_cut_into_many_rows(spark):
    left, _ = frames(spark, [(0.0, 1e9), (5.0, 5.5)], [])
    rows = left.selectExpr("*", "a __start", "b __end").withColumn("__level", intervals._level(left["a"], left["b"]))
    assert intervals._spread(rows, [-3, 0, 30], -20).count() <= 2 + 3 * 2


def test_no_nested_loop_and_equal_names(spark):
    left, right = frames(spark, [(0.0, 1.0)], [(0.0, 1.0)])
    plan = overlap_join(left, right, ("a", "b"), ("c", "d"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError):
        overlap_join(left, left, ("a", "b"), ("a", "b"))
