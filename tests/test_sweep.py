"""The plane sweep against the nested loop, its early stop, hot tiles, and mergeable states."""

import numpy as np
import pyarrow as pa
import pytest

from knnloom.operators import aknn_join, candidate_stats, merge, run_metrics
from knnloom.operators import states as states_module
from knnloom.operators.states import best, merge_states, nearest_states, partial_states, ranked, state_batch
from knnloom.plans import compared
from knnloom.plans import sweep as sweep_module

from .test_join import CASES, RNG, frame, run, want


@pytest.mark.parametrize("case", CASES)
def test_equals_nested_loop(spark, case, monkeypatch):
    q, t, k, options = CASES[case]
    for name, value in (("TILE_ROWS", 24), ("MOST_POINTS", 16), ("CELLS", 60)):
        monkeypatch.setattr(sweep_module, name, value)
    assert run(spark, q, t, k, "sweep", **options) == want(q, t, k)


def test_kernel_on_random_tiles():
    rng = np.random.default_rng(11)
    for trial in range(60):
        n, m, k = int(rng.integers(1, 90)), int(rng.integers(1, 40)), int(rng.integers(1, 12))
        scale = [1.0, 1e-3, 1e6][trial % 3]
        c, q = (np.round(rng.normal(0, 1, (x, 2)) * [10, 3], trial % 2) * scale for x in (n, m))  # rounded: many ties
        ids = rng.permutation(n) + 1
        limit = np.where(rng.random(m) < 0.5, np.inf, rng.random(m) * 30 * scale**2)
        owner, far, near, seen = sweep_module.swept(q[:, 0], q[:, 1], limit, c[:, 0], c[:, 1], ids, k)
        d = (c[None, :, 0] - q[:, None, 0]) ** 2 + (c[None, :, 1] - q[:, None, 1]) ** 2
        expected = [(i, d[i, j], ids[j]) for i in range(m) for j in np.lexsort((ids, d[i])) if d[i, j] <= limit[i]]
        kept = [r for x in range(m) for r in [r for r in expected if r[0] == x][:k]]
        assert list(zip(owner.tolist(), far.tolist(), near.tolist(), strict=True)) == kept
        assert (seen <= 3 * n + 4 * k).all()


def test_few_distances_are_taken():
    rng = np.random.default_rng(2)
    c, q = rng.random((4096, 2)), rng.random((500, 2))
    seen = sweep_module.swept(q[:, 0], q[:, 1] * 0.02, np.full(500, np.inf), c[:, 0], c[:, 1] * 0.02, np.arange(4096), 10)[3]
    assert seen.mean() < 4096 / 20


def test_takes_fewer_distances_than_blocks(spark):
    q, t = frame(spark, RNG.random((3000, 2))), frame(spark, RNG.random((20_000, 2)))
    mean = {name: candidate_stats(compared(name, q, t, 10)).first()["mean"] for name in ("sweep", "grid")}
    assert mean["sweep"] < mean["grid"]


def test_hot_tile_is_dealt_out(spark, monkeypatch):
    for name, value in (("TILE_ROWS", 64), ("MOST_POINTS", 50)):
        monkeypatch.setattr(sweep_module, name, value)
    q, t = np.c_[RNG.random(2000) * 0.02, np.full(2000, 0.5)], RNG.random((1000, 2))
    groups = []
    dealt = sweep_module.dealt

    def watched(points, training, tasks):
        sides = dealt(points, training, tasks)
        groups.append([{(r["tile"], r["part"]): r["count"] for r in s.groupBy("tile", "part").count().collect()} for s in sides])
        return sides

    monkeypatch.setattr(sweep_module, "dealt", watched)
    assert run(spark, q, t, 4, "sweep") == want(q, t, 4)
    assert len(groups) == 2 and sum(groups[0][0].values()) == 2000
    assert len(groups[0][0]) >= 2000 / 100  # not one task for the one stripe
    for points, candidates in groups:
        assert max(points.values(), default=0) <= 2 * 50
        assert max(candidates.values()) <= 8 * 64 and set(points) <= set(candidates)


def test_no_points_or_candidates(spark):
    none, some = frame(spark, []), frame(spark, [(0.5, 0.5)])
    assert aknn_join(none, some, 3, "sweep").count() == 0 and aknn_join(some, none, 3, "sweep").count() == 0
    assert [tuple(r) for r in aknn_join(some, none, 2, "sweep", pad=True).orderBy("rnk").collect()] == [(1, 1, None, None), (1, 2, None, None)]


def test_metrics_of_the_sweep(spark):
    q, t = frame(spark, RNG.random((50, 2))), frame(spark, RNG.random((300, 2)))
    rows = {r["strategy"]: r for r in run_metrics(["brute", "sweep"], q, t, 5).collect()}
    assert rows["sweep"]["differences"] == 0 and rows["sweep"]["candidates_total"] < rows["brute"]["candidates_total"] == 15_000


def pairs(seed, points=40, n=2000):
    rng = np.random.default_rng(seed)
    owner, far = rng.integers(0, points, n), np.round(rng.random(n), 2)
    return [(int(o), int(i), float(d)) for o, i, d in zip(owner, rng.permutation(n), far, strict=True)]


def nearest(rows, k):
    out = {}
    for o, i, d in rows:
        out.setdefault(o, []).append((d, i))
    return sorted((o, r, i, d) for o, near in out.items() for r, (d, i) in enumerate(sorted(near)[:k], 1))


@pytest.mark.parametrize(("held", "k"), [(1 << 20, 7), (50, 7), (10, 1), (300, 5000)])
def test_partial_states_in_little_memory(monkeypatch, held, k):
    monkeypatch.setattr(states_module, "HELD", held)
    rows = pairs(1)
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 97], strict=True)], ["input_id", "neighbor_id", "dist_sq"]) for i in range(0, len(rows), 97)]
    states = list(partial_states(k)(batches))
    assert max(len(x) for b in states for x in b.column(1)) <= k
    flat = [(o, i, d) for b in states for o, ids, far in zip(*(c.to_pylist() for c in b.columns), strict=True) for i, d in zip(ids, far, strict=True)]
    assert nearest(flat, k) == nearest(rows, k)


def test_states_merge_in_any_order(spark):
    rows = pairs(3)
    parts = [rows[i::3] for i in range(3)]
    schema = "input_id bigint, neighbor_id bigint, dist_sq double"
    made = [nearest_states(spark.createDataFrame(p, schema).repartition(4), 6) for p in parts]
    for order in ((0, 1, 2), (2, 0, 1)):
        union = made[order[0]].unionByName(made[order[1]])
        got = ranked(merge_states(merge_states(union, 6).unionByName(made[order[2]]), 6))
        assert sorted(map(tuple, got.collect())) == nearest(rows, 6)
    results = [ranked(m) for m in made]
    padded = results[0].unionByName(spark.createDataFrame([(0, 9, None, None)], results[0].schema))
    assert sorted(map(tuple, merge([padded, *results[1:]], 6).collect())) == nearest(rows, 6)


def test_few_rows_are_shuffled(spark):
    rows = spark.createDataFrame(pairs(4, points=10, n=4000), "input_id bigint, neighbor_id bigint, dist_sq double").repartition(5)
    partial = rows.mapInArrow(partial_states(3), states_module.STATE)
    assert partial.count() <= 10 * 5 and partial.selectExpr("max(size(ids)) n").first()["n"] <= 3


def test_best_of_nothing():
    assert not len(best(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), 3))
    assert state_batch(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)).num_rows == 0


def test_every_column_of_the_metrics_is_filled(spark, tmp_path):
    q, t = frame(spark, RNG.random((50, 2))), frame(spark, RNG.random((300, 2)))
    rows = {r["strategy"]: r.asDict() for r in run_metrics(["brute", "sweep", "grid"], q, t, 5, save=lambda name, result, seconds: result.write.parquet(str(tmp_path / name))).collect()}
    for name, r in rows.items():
        assert [c for c, v in r.items() if v is None] == (["stripes"] if name == "brute" else [])
        assert r["total_seconds"] >= r["sorting_seconds"] >= 0 and r["commit_seconds"] > 0 and r["final_sort_seconds"] > 0 and r["second_pass_windows"] > 0
    assert rows["brute"]["first_pass_windows"] == 0 and min(rows[s]["first_pass_windows"] for s in ("sweep", "grid")) > 0
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
