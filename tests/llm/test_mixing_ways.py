"""Many sources and many ranges take other ways to the same mix."""

import pytest
from pyspark.sql import functions as F

from knnloom.llm import mixing

from ..conftest import DATA

COLUMNS = ["doc_id", "size", "source_size", "target", "taken", "copies"]


def rows(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=str)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "source", "text")


def test_sources_are_ranked_on_the_cluster(spark, docs, odd, none):
    many = docs.withColumn("source", F.when(F.col("doc_id") % 9 > 0, F.concat("source", (F.col("doc_id") % 9).cast("string"))))
    for table in (docs, many, odd, none):
        assert rows(mixing.mix(table, most_sources=0)) == rows(mixing.mix(table))


@pytest.mark.parametrize(("ranges", "last"), [(4, 1), (2, 3), (1024, 1)])
def test_cut_is_found_in_narrowing_ranges(spark, docs, monkeypatch, ranges, last):
    want = rows(mixing.mix(docs))
    monkeypatch.setattr(mixing, "RANGES", ranges)
    monkeypatch.setattr(mixing, "LAST_ROWS", last)
    assert rows(mixing.mix(docs)) == want


def test_rows_to_the_driver_do_not_grow(spark, docs, monkeypatch):
    """The sums that are collected are as many for eight times the documents."""
    seen = []
    real = mixing.cut_of

    def counted(items, budget):
        frame = type(items)
        collect = frame.collect
        monkeypatch.setattr(frame, "collect", lambda self: (lambda out: (seen.append(len(out)), out)[1])(collect(self)))
        try:
            return real(items, budget)
        finally:
            monkeypatch.setattr(frame, "collect", collect)

    monkeypatch.setattr(mixing, "cut_of", counted)
    eight = docs.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(7)))).select((F.col("doc_id") * 8 + F.col("n")).alias("doc_id"), "source", "text")
    for table in (docs, eight):
        mixing.mix(table, columns=["doc_id"]).count()
    assert seen and max(seen) <= mixing.RANGES + 1
