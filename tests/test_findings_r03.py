"""Registered queries on tables with rows that the small test tables lack."""

import __spark_entry__ as entry
import duckdb
import pytest

from .conftest import DATA
from .test_queries import same

SMALL = f"{DATA}/sf0.001"


def against_sql(spark, folder, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    same(entry.queries()[name](spark, str(folder)).toPandas(), con.execute(entry.oracle_sql()[name]).df())


def copied(folder, table, change, times=1):
    """A test table with columns replaced, ``times`` over; ``c`` numbers the copies."""
    duckdb.connect().execute(f"copy (select * replace ({change}) from '{SMALL}/{table}.parquet', range({times}) r(c)) to '{folder}/{table}.parquet'")


def test_spans_of_no_length_meet_nothing(spark, tmp_path):
    duckdb.connect().execute(f"copy (select * replace (CASE WHEN event_id % 3 = 0 THEN 0 ELSE 40 * value END AS value) from '{SMALL}/events.parquet') to '{tmp_path}/events.parquet'")
    against_sql(spark, tmp_path, "interval_pairs", "events")


def test_nested_loop_makes_no_rows_of_pairs(spark):
    from knnloom.operators import candidate_counts, generate_uniform, heap_additions, nested_states
    from knnloom.plans import brute, ranked_counts

    p = generate_uniform(spark, 50, 1)
    for df in (brute.brute(p, p, 3), nested_states(p, p, 3), heap_additions(p, p, 3)):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    plan = ranked_counts("brute", p, p, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")  # candidates are counted before they meet the points


def test_nearest_of_a_pack(monkeypatch):
    import numpy as np

    from knnloom.operators import allpairs

    monkeypatch.setattr(allpairs, "CELLS", 64)
    monkeypatch.setattr(allpairs, "HELD", 50)
    rng = np.random.default_rng(4)
    q, t = np.round(rng.random((9, 2)), 1), np.round(rng.random((1500, 2)), 1)
    for n in (1500, 3, 0):
        pack = allpairs.Nearest(np.arange(9), q[:, 0], q[:, 1], 5)
        for a in range(0, n, 700):
            pack.feed(np.arange(a, min(a + 700, n)), *(t[a : min(a + 700, n), c] for c in (0, 1)))
        d = ((t[None, :n] - q[:, None]) ** 2).sum(2)
        want = np.argsort(d, axis=1, kind="stable")[:, :5].tolist()
        assert [x for b in pack.rows() for x in b.column(1).to_pylist()] == want


@pytest.mark.parametrize("name", ["aknn_brute_emb_k10", "aknn_states_of_pairs", "heap_additions_brute", "heap_additions_stats", "candidates_brute_stats"])
def test_nested_loop_in_many_packs_and_chunks(spark, tmp_path, monkeypatch, name):
    from knnloom.operators import allpairs

    monkeypatch.setattr(allpairs, "PACK", 40)
    copied(tmp_path, "embeddings", "vec_id AS vec_id")
    against_sql(spark, tmp_path, name, "embeddings")


@pytest.mark.parametrize("name", ["grid", "stripes_input", "sweep_x"])
def test_copies_of_points_are_joined_once(spark, name):
    from pyspark.sql import functions as F

    from knnloom.operators import aknn_join, candidate_counts, generate_uniform
    from knnloom.plans import candidate_rows

    p = generate_uniform(spark, 200, 2)
    p = p.withColumn("id", F.explode(F.array(*(F.col("id") + 1000 * c for c in range(40)))))
    assert candidate_counts(candidate_rows(name, p, p, 3), p).agg(F.max("n")).first()[0] == 3
    rows = lambda s: sorted(tuple(r) for r in aknn_join(p, p, 3, s).collect())
    assert rows(name) == rows("brute")


def test_blocks_where_one_axis_has_few_values(spark):
    from pyspark.sql import functions as F

    from knnloom.operators import generate_uniform
    from knnloom.plans import compared

    p = generate_uniform(spark, 20_000, 2).withColumn("y", F.floor(F.col("y") * 4) / 4)
    assert compared("grid", p.where("id % 50 = 0"), p, 5).agg(F.avg("n")).first()[0] < 350


def test_segmentation_holds_little_and_slices_change_nothing(monkeypatch):
    import numpy as np
    import pyarrow.parquet as pq

    from knnloom.llm import segmentation as s

    assert s.SLICE_BYTES <= 1 << 18 and s.WORD_BYTES <= 1 << 20
    t = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).slice(0, 60)
    keys, col = t["doc_id"].to_numpy(), t["text"].combine_chunks()
    made = lambda: [[(x[0].tolist(), *x[1:]) for x in r] for r in s.sample_segmentations(np.asarray(keys), col)]
    few = made()
    monkeypatch.setattr(s, "SLICE_BYTES", 1 << 20)
    assert made() == few


def test_a_run_plans_each_strategy_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from knnloom.operators import candidate_stats, generate_uniform, run_metrics
    from knnloom.plans import ranked_counts, tiles

    p = generate_uniform(spark, 120, 2)
    p = p.withColumn("id", F.explode(F.array(*(F.col("id") + 1000 * c for c in range(5)))))
    want = [tuple(candidate_stats(ranked_counts(s, p, p, 3)).first()) for s in ("grid", "stripes_training")]
    plans, plan = [], tiles._reached
    monkeypatch.setattr(tiles, "_reached", lambda *a, **o: plans.append(o) or plan(*a, **o))
    rows = run_metrics(["grid", "stripes_training"], p, p, 3).collect()
    assert len(plans) == 2 and [r["differences"] for r in rows] == [0, 0]
    assert [tuple(r[f"candidates_{c}"] for c in ("total", "least", "most", "mean")) for r in rows] == want


def test_near_dedup_takes_candidates_by_golay_keys(spark, monkeypatch):
    """Of copies of similarity 0.95 most are found without MinHash keys, and all with them; none is found below 0.8."""
    import corpus_pipeline
    import numpy as np

    from knnloom.llm import resemblance, simhash

    rng = np.random.default_rng(3)
    texts = []
    for i in range(40):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
        texts += [(3 * i, " ".join(words)), (3 * i + 1, " ".join("new" if k in (100, 300) else w for k, w in enumerate(words))), (3 * i + 2, " ".join("new" if k % 20 == 9 else w for k, w in enumerate(words)))]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    reach, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda d, *bits: reach.append(bits) or links(d, *bits))
    kept = lambda: {r[0] for r in corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect()}
    assert kept() == {i for i, _ in texts if i % 3 != 1}
    monkeypatch.setattr(resemblance, "BANDS", 0)
    left = kept()
    assert {i for i, _ in texts if i % 3 != 1} <= left and len(left) <= 90 and reach == [(simhash.REACH,)] * 2


def test_counts_of_the_deleted_part_are_added_up_few_at_a_time():
    """However many texts a batch has, memory is that of TUNED tokens; the sums stay."""
    import tracemalloc
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    from knnloom.llm import interpolation as m

    rng = np.random.default_rng(7)
    sizes, length = m.Sizes(9000, 10**9, 10**5, 8000, 9 * 10**8, 10**5), 1000
    n = [rng.choice([1, 2, 3, 10**6, 2 * 10**7], (2, length)).astype(np.uint64) for _ in range(50)]
    part = [pa.array(x, kind) for x, kind in (([length] * 50, pa.int64()), ([m.packed(x.ravel()) for x in n], pa.binary()), ([m.packed(np.ones_like(x).ravel()) for x in n], pa.binary()))]
    batch = lambda times: pa.RecordBatch.from_arrays([pa.concat_arrays([c] * times) for c in part], ["n_tokens", "__n", "__deleted"])
    made, _ = m.deleted_rows(2, sizes)

    def peak(times):
        tracemalloc.start()
        total = Counter()
        for out in made(iter([batch(times)])):
            for w, *kind in zip(*(c.to_pylist() for c in out.columns), strict=True):
                total[tuple(kind)] += w
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most, total

    few, one = peak(12)
    many, all_ = peak(60)
    assert all_ == Counter({k: 5 * w for k, w in one.items()}) and sum(one.values()) == 12 * 50 * length
    assert many < 1.3 * few


def test_distinct_rows_of_any_width():
    import numpy as np

    from knnloom.llm.interpolation import distinct_rows

    rng = np.random.default_rng(8)
    for high in (4, 1 << 40):
        rows = rng.integers(0, 3, (500, 4)) * high + 7
        kind, times = distinct_rows(rows)
        want = np.unique(rows, axis=0, return_counts=True)
        order = np.lexsort(kind.T[::-1])
        assert (kind[order] == want[0]).all() and (times[order] == want[1]).all()


def test_tasks_that_merge_grow_in_number_with_the_points(spark, monkeypatch):
    from knnloom.operators import aknn_join, generate_uniform, merge, results

    monkeypatch.setattr(results, "MERGED", 100)
    q, t = generate_uniform(spark, 60, 3), generate_uniform(spark, 90, 4)
    parts = [aknn_join(q, t.where(f"id % 2 = {r}"), 5, "brute") for r in range(2)]
    merged = merge(parts, 5, 60)
    assert merged.rdd.getNumPartitions() == 6
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(merged) == rows(merge(parts, 5)) == rows(aknn_join(q, t, 5, "brute"))
