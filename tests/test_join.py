"""Every strategy against the nested loop, on data that is hard on stripes."""

import numpy as np
import pandas as pd
import pytest

from knnloom.operators import aknn_join, difference_ids, first_differences, merge, nested, positions, result_lines, run_metrics
from knnloom.plans import FAMILIES, strategy_mask
from knnloom.plans import tiles as tiles_module

TILED = ["sweep_x", "stripes_input", "stripes_training", "grid"]


def frame(spark, xy, ids=None):
    xy = np.asarray(xy, float).reshape(-1, 2)
    ids = np.arange(1, len(xy) + 1) if ids is None else np.asarray(ids)
    return spark.createDataFrame(pd.DataFrame({"id": ids.astype("int64"), "x": xy[:, 0], "y": xy[:, 1]}), "id bigint, x double, y double")


def expected(q, t, k):
    rows = []
    for i, (a, b) in zip(*q, strict=True):
        d = sorted((((x - a) * (x - a) + (y - b) * (y - b)), j) for j, (x, y) in zip(*t, strict=True))[:k]
        rows += [(int(i), r, int(j), s) for r, (s, j) in enumerate(d, 1)]
    return sorted(rows)


def run(spark, q, t, k, name, **options):
    got = aknn_join(frame(spark, q), frame(spark, t), k, name, **options).collect()
    return sorted(tuple(r) for r in got)


def want(q, t, k):
    q, t = (np.asarray(v, float).reshape(-1, 2) for v in (q, t))
    return expected((range(1, len(q) + 1), q), (range(1, len(t) + 1), t), k)


RNG = np.random.default_rng(5)
CASES = {
    "uniform": (RNG.random((60, 2)), RNG.random((200, 2)), 4, {}),
    "clustered": (RNG.normal(0, 1, (40, 2)) * 0.01 + RNG.integers(0, 3, (40, 1)), RNG.normal(0, 1, (150, 2)) * 0.01 + RNG.integers(0, 3, (150, 1)), 5, {}),
    "constant y": (np.c_[RNG.random(30), np.full(30, 0.5)], np.c_[RNG.random(90), np.full(90, 0.5)], 3, {"stripes": 7}),
    "constant x": (np.c_[np.full(30, 0.5), RNG.random(30)], np.c_[np.full(90, 0.5), RNG.random(90)], 3, {}),
    "all the same": (np.ones((10, 2)), np.ones((50, 2)), 3, {"stripes": 5}),
    "long run of equal y": (RNG.random((20, 2)), np.r_[np.c_[RNG.random(150), np.full(150, 0.5)], RNG.random((50, 2))], 4, {"stripes": 20}),
    "far from the unit square": (RNG.normal(0, 1e6, (30, 2)), RNG.normal(0, 1e6, (120, 2)), 4, {"stripes": 15}),
    "fewer than k": (RNG.random((8, 2)), RNG.random((3, 2)), 6, {}),
    "one candidate": (RNG.random((5, 2)), RNG.random((1, 2)), 1, {"stripes": 9}),
    "sparse stripes": (RNG.random((40, 2)), np.c_[RNG.random(120), RNG.random(120) ** 6], 10, {"stripes": 60}),
    "lattice with ties": (np.indices((5, 5)).reshape(2, -1).T, np.indices((9, 9)).reshape(2, -1).T, 6, {"stripes": 4}),
    "crowd at one place": (np.r_[np.full((20, 2), 0.25), RNG.random((20, 2))], np.r_[np.full((150, 2), 0.25), RNG.random((150, 2))], 4, {}),
    "crowd on one line": (np.c_[RNG.random(40), np.full(40, 0.5)], np.r_[np.c_[RNG.random(300), np.full(300, 0.5)], RNG.random((30, 2))], 4, {"stripes": 30}),
    "squared gap": ([(0, 0)], [(3, 0), (0.1, 10), (0.5, 2)], 1, {"stripes": 2}),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("name", TILED)
def test_equals_nested_loop(spark, case, name, monkeypatch):
    monkeypatch.setattr(tiles_module, "BLOCK_ROWS", 8)
    monkeypatch.setattr(tiles_module, "FEWEST", 1)
    q, t, k, options = CASES[case]
    assert run(spark, q, t, k, name, **options) == want(q, t, k)


@pytest.mark.parametrize("case", CASES)
def test_blocks_as_tables_equal_the_nested_loop(spark, case, monkeypatch):
    monkeypatch.setattr(tiles_module, "BLOCK_ROWS", 8)
    monkeypatch.setattr(tiles_module, "FEWEST", 1)
    monkeypatch.setattr(tiles_module, "MAX_BLOCKS", 0)
    q, t, k, options = CASES[case]
    assert run(spark, q, t, k, "sweep_x" if case == "clustered" else "grid", **options) == want(q, t, k)


@pytest.mark.parametrize("case", sorted(CASES))
def test_stripes_of_many_points_are_dealt_to_parts(spark, case, monkeypatch):
    monkeypatch.setattr(tiles_module, "BLOCK_ROWS", 8)
    monkeypatch.setattr(tiles_module, "FEWEST", 1)
    monkeypatch.setattr(tiles_module, "MAX_BLOCKS", 0)
    monkeypatch.setattr(tiles_module, "WINDOW_POINTS", 5)
    q, t, k, options = CASES[case]
    assert run(spark, q, t, k, "sweep_x" if case == "clustered" else "grid", **options) == want(q, t, k)

def test_blocks_do_not_grow_with_the_data(spark, monkeypatch):
    """Candidates ranked for a point are about as many for eight times the points, and what is collected grows by the root."""
    from knnloom.operators import candidate_counts, generate_uniform
    from knnloom.plans import candidate_rows

    monkeypatch.setattr(tiles_module, "MAX_BLOCKS", 0)
    mean = []
    for n in (4000, 32_000):
        p = generate_uniform(spark, n, 3)
        q = p.where("id <= 500")
        mean.append(candidate_counts(candidate_rows("grid", q, p, 5), q).agg({"n": "avg"}).first()[0])
    assert mean[1] < 1.5 * mean[0]


def test_brute(spark):
    q, t, k, _ = CASES["uniform"]
    assert run(spark, q, t, k, "brute") == want(q, t, k)


@pytest.mark.parametrize("name", ["brute", *TILED])
def test_empty_sides(spark, name):
    some, none = frame(spark, RNG.random((4, 2))), frame(spark, [])
    assert aknn_join(none, some, 2, name).count() == 0
    padded = aknn_join(some, none, 2, name, pad=True).collect()
    assert len(padded) == 8 and all(r["neighbor_id"] is None and r["dist_sq"] is None for r in padded)


def test_ids_are_opaque(spark):
    t = frame(spark, [(0, 0), (1, 1), (5, 5)], [0, 10**15, 7])
    got = aknn_join(frame(spark, [(0, 0)], [-4]), t, 2, "grid").orderBy("rnk").collect()
    assert [(r["input_id"], r["neighbor_id"]) for r in got] == [(-4, 0), (-4, 10**15)]


def test_crowd_is_not_joined_pair_by_pair(spark):
    from knnloom.operators import candidate_counts
    from knnloom.plans import candidate_rows

    xy = np.r_[np.full((2000, 2), 0.5), RNG.random((1000, 2))]
    p = frame(spark, xy)
    most = candidate_counts(candidate_rows("grid", p, p, 3), p).agg({"n": "max"}).first()[0]
    assert most < 400


def test_bad_arguments(spark):
    p = frame(spark, [(0, 0)])
    with pytest.raises(ValueError):
        aknn_join(p, p, 0)
    with pytest.raises(ValueError):
        aknn_join(p, p, 1, "no such")


def test_points_that_are_not_finite_are_left_out(spark):
    t = frame(spark, [(0, 0), (float("nan"), 0), (float("inf"), 1)])
    assert [r["neighbor_id"] for r in aknn_join(t, t, 3, "grid").collect()] == [1]


def test_differences(spark):
    q, t, k, _ = CASES["uniform"]
    a = aknn_join(frame(spark, q), frame(spark, t), k, "brute").persist()
    assert difference_ids(a, aknn_join(frame(spark, q), frame(spark, t), k, "grid"), 0.0).count() == 0
    off = a.selectExpr("input_id", "rnk", "neighbor_id", "dist_sq + if(input_id % 9 = 0 and rnk = 2, 1e-6, 0.0) as dist_sq").where("not (input_id = 5 and rnk = 4)")
    assert sorted(r[0] for r in difference_ids(a, off).collect()) == [5, 9, 18, 27, 36, 45, 54]
    assert [r[0] for r in first_differences(a, off).collect()] == [5, 9, 18, 27, 36]
    assert [r[0] for r in difference_ids(a, off, 1e-3).collect()] == [5]


def test_forms_of_a_result(spark):
    r = aknn_join(frame(spark, [(0, 0)]), frame(spark, [(3, 0), (1, 0)]), 3, "brute", pad=True)
    assert [n["neighbor_id"] for n in nested(r).first()["neighbors"]] == [2, 1, None]
    assert {(x["position"], x["neighbor_id"]) for x in positions(r, 3).collect()} == {(2, 2), (1, 1), (0, None)}
    assert result_lines(r).first()["line"] == "1\t(NULL 1.79769e+308)\t(1 9)\t(2 1)"
    assert result_lines(r, full=True).first()["line"] == "1\t(NULL 1.7976931348623157E308)\t(1 9.0)\t(2 1.0)"


def test_metrics_compare_strategies(spark):
    q, t, k, _ = CASES["uniform"]
    rows = run_metrics(["brute", "stripes_training", "grid"], frame(spark, q), frame(spark, t), k).collect()
    assert [(r["strategy"], r["differences"], r["first_ids"], r["stripes"]) for r in rows] == [("brute", 0, "", None), ("stripes_training", 0, "", 7), ("grid", 0, "", 7)]
    assert (rows[0]["candidates_total"], rows[0]["candidates_least"], rows[0]["candidates_mean"]) == (12000, 200, 200.0)
    assert all(k <= r["candidates_least"] <= r["candidates_most"] < 200 for r in rows[1:])


def test_metrics_leave_out_points_that_are_not_finite(spark):
    p = frame(spark, [(0, 0), (1, 1), (float("nan"), 0)])
    saved = {}
    rows = run_metrics(["brute", "grid"], p, p, 3, pad=True, save=lambda name, result, seconds: saved.update({name: sorted(map(tuple, result.collect()), key=str)})).collect()
    assert [r["differences"] for r in rows] == [0, 0] and saved["brute"] == saved["grid"]
    assert len(saved["grid"]) == 6 and sum(r[2] is None for r in saved["grid"]) == 2
    with pytest.raises(ValueError):
        run_metrics(["brute"], p, p, 0)


def test_heap_additions(spark):
    from knnloom.operators import heap_additions

    q, t = RNG.random((7, 2)), np.round(RNG.random((300, 2)), 1)
    want = {}
    for i, (a, b) in enumerate(q, 1):
        heap, n = [], 0
        for x, y in t:
            d = (x - a) * (x - a) + (y - b) * (y - b)
            if len(heap) < 5 or d < heap[-1]:
                heap, n = sorted([*heap, d])[:5], n + 1
        want[i] = n
    got = heap_additions(frame(spark, q), frame(spark, t), 5).collect()
    assert {r["input_id"]: r["additions"] for r in got} == want
    assert heap_additions(frame(spark, q), frame(spark, []), 5).count() == 0


def test_merge_of_parts(spark):
    q, t, k, _ = CASES["lattice with ties"]
    q, t = frame(spark, q), frame(spark, t)
    parts = [aknn_join(q, t.where(f"id % 3 = {r}"), k, "brute", pad=True) for r in range(3)]
    assert sorted(map(tuple, merge(parts, k).collect())) == sorted(map(tuple, aknn_join(q, t, k, "brute").collect()))


def test_own_strategy(spark):
    from knnloom.plans import register

    register("first_of_all", lambda q, t, k, **_: aknn_join(q, t, 1, "brute"))
    p = frame(spark, [(0, 0), (1, 1)])
    assert aknn_join(p, p, 2, "first_of_all").count() == 2
    rows = run_metrics(["brute", "first_of_all"], p, p, 2).collect()
    assert [(r["strategy"], r["differences"], r["candidates_total"]) for r in rows] == [("brute", 0, 4), ("first_of_all", 2, None)]
    del FAMILIES["first_of_all"]


def test_mask():
    assert strategy_mask("1" * 30) == ["brute", "sweep_x", "stripes_input", "stripes_training"]
    assert strategy_mask("0001") == ["sweep_x"]
    with pytest.raises(ValueError):
        strategy_mask("2")


def test_plans_of_tiles_have_no_cross_join(spark):
    q, t, k, _ = CASES["uniform"]
    for name in TILED:
        plan = aknn_join(frame(spark, q), frame(spark, t), k, name)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert "WindowGroupLimit" in plan
