"""Places of rows, shards and near-duplicates don't depend on how a scan is cut into partitions."""

import os

import pytest
from pyspark.sql import functions as F

from knnloom.llm.session import drop_tables, pinned, placed, tables
from knnloom.llm.sharding import shuffle_shards, write_shards
from knnloom.llm.suffix_dedup import with_repeats

from ..conftest import DATA

SMALL = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Thirty files, in which rows repeat."""
    path = str(tmp_path_factory.mktemp("many") / "documents.parquet")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs.unionByName(docs.limit(40)).repartition(30, F.rand(1)).write.parquet(path)
    return path


def cut(spark, n):
    """Scans are cut into about n partitions from now on."""
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(n))
    spark.conf.set("spark.sql.files.openCostInBytes", "4096")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(max(1 << 12, (1 << 20) // n)))


@pytest.fixture(autouse=True)
def uncut(spark):
    yield
    for key in ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes"):
        spark.conf.unset(key)


def test_places(spark, many):
    docs = spark.read.parquet(many)
    seen = []
    for n in (1, 4, 64):
        cut(spark, n)
        seen.append(sorted((r["place"], r["doc_id"], r["text"]) for r in placed(docs.where("doc_id is not null"), "place").collect()))
    assert seen[0] == seen[1] == seen[2] and len({r[0] for r in seen[0]}) == docs.count()
    joined = docs.join(docs.select("doc_id").distinct(), "doc_id")
    assert placed(joined, "place").select("place").distinct().count() == joined.count()


def test_places_beside_a_column_of_that_name(spark, tmp_path):
    spark.range(50).selectExpr("id as doc_id", "'x' as _metadata", "'y' as file_path").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = placed(docs, "place")
    assert got.columns == [*docs.columns, "place"] and got.select("place").distinct().count() == 50
    assert {r["_metadata"] for r in got.collect()} == {"x"}
    assert placed(spark.createDataFrame([(1, "a")], "doc_id int, _metadata string"), "place").count() == 1


def test_places_survive_other_partitions_between_plan_and_run(spark, many):
    cut(spark, 2)
    rows = placed(spark.read.parquet(many), "place")
    before = {(r["place"], r["doc_id"]) for r in rows.collect()}
    cut(spark, 32)
    assert {(r["place"], r["doc_id"]) for r in placed(spark.read.parquet(many), "place").collect()} == before


def test_shards_do_not_depend_on_cores(spark, many):
    seen = []
    for n, parts in ((1, 3), (16, 7)):
        cut(spark, n)
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = shuffle_shards(spark.read.parquet(many), bucket_bytes=50_000)
        cut(spark, 5 * n)  # between plan and run
        seen.append(sorted((r["shard"], r["slot"], r["doc_id"], r["text"]) for r in got.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]
    slots = {}
    for shard, slot, _, _ in seen[0]:
        slots.setdefault(shard, []).append(slot)
    assert sorted(slots) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_written_in_order(spark, many, tmp_path):
    docs = spark.read.parquet(many)
    write_shards(docs, str(tmp_path / "out"), file_rows=4, shards=8, bucket_bytes=50_000)
    n = docs.count()
    for shard in range(8):
        folder = tmp_path / "out" / f"shard={shard}"
        files = sorted(f for f in os.listdir(folder) if f.endswith(".parquet"))
        want = -(-(n - shard) // 8)
        assert 1 <= len(files) <= -(-want // 4)
        slots = []
        for f in files:
            part = [r["slot"] for r in spark.read.parquet(str(folder / f)).select("slot").collect()]
            assert part == sorted(part)
            slots += part
        assert sorted(slots) == list(range(want))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select(*docs.columns).exceptAll(docs).count() == 0 and back.count() == n


def test_shuffles_of_buckets_are_even(spark):
    """A record's new number is as likely to be any number of its bucket."""
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("x" * 20).alias("text"))
    place = {}
    for seed in range(6):
        for r in shuffle_shards(pinned(rows), 1, seed=seed, bucket_bytes=10_000).collect():
            place.setdefault(r["doc_id"], []).append(r["slot"])
    mean = [sum(place[i]) / 6 for i in range(2000)]
    assert 900 < sum(mean[:200]) / 200 < 1100 and 900 < sum(mean[-200:]) / 200 < 1100


def test_cuts_do_not_depend_on_cores(spark, many):
    seen = []
    for n in (1, 16):
        cut(spark, n)
        got = with_repeats(spark.read.parquet(many).select("doc_id", "text"))
        cut(spark, 3 * n + 2)
        seen.append(sorted((r["doc_id"], [tuple(s) for s in r["spans"]]) for r in got.collect()))
    assert seen[0] == seen[1]


def test_tables_are_dropped(spark):
    first = tables()
    a, b = pinned(spark.range(5).toDF("n")), pinned(spark.range(7).toDF("n"))
    drop_tables(first, b)
    assert b.count() == 7
    with pytest.raises(Exception, match="(?i)exist"):
        a.collect()
