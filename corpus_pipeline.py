"""A corpus pipeline over the documents table: STAGES, applied in order by ``run``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.  ``run`` writes each stage's result as Parquet
in the shared folder and reads it back as the next one's documents.

Nulls in any column, empty and very long texts, repeated rows and empty tables
are handled as the operators' modules define; extra columns pass through, those
whose names begin with ``__`` excepted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knnloom.llm.mixing import mixed_documents
from knnloom.llm.quality import fit_quality, with_quality
from knnloom.llm.segmentation import with_segmentations
from knnloom.llm.session import drop_tables, pinned, placed, tables
from knnloom.llm.simhash import near_duplicates
from knnloom.llm.suffix_dedup import with_repeats

#: Documents whose probability of good quality is below this go.
KEEP_FROM = 0.3
#: Near-duplicates: words of a shingle, and the similarity of sets of them.
WORDS, LEAST = 5, 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, doesn't reject."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_quality(docs, model, "__quality").where(F.col("__quality") >= KEEP_FROM).drop("__quality")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the first row of the smallest id (null ids last)."""
    rows = placed(docs, "__place").withColumn("__row", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__place").alias("place")))
    groups = near_duplicates(rows, "__row", "text", words=WORDS, least=LEAST)
    first = groups.where(F.col("id") == F.col("component_id")).select(F.col("id.place").alias("__kept"))
    return rows.join(first, F.col("__place") == F.col("__kept")).select(*(F.col(f"`{c}`") for c in docs.columns))


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that documents of smaller id hold; those that have nothing left go."""
    cut = with_repeats(docs, out="__spans", kept="__kept")
    text = F.when(F.size("__spans") > 0, F.col("__kept")).otherwise(F.col("text"))
    kept = cut.withColumn("__text", text).where((F.size("__spans") == 0) | (F.trim("__text") != ""))
    columns = {"text": F.col("__text"), "n_chars": F.when(F.size("__spans") > 0, F.length("__text").cast("bigint")).otherwise(F.col("n_chars"))}
    return kept.select(*(columns.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: documents as often as it takes them."""
    return mixed_documents(docs)


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of the mix: pieces, log-probability and inclusion of each; copies of a document draw apart."""
    copy = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(1)))
    rows = docs.select("doc_id", "source", "text").withColumn("__copy", copy).withColumn("__key", F.xxhash64("doc_id", "__copy"))
    return with_segmentations(rows, "__key").select("doc_id", "source", "segmentations")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("repeat_dedup", repeat_dedup), ("mixing", mixing), ("segmentation", segmentation)]
#: SQL can't express the first stage, nor the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, first = spark.read.parquet(f"{sf_dir}/documents.parquet"), tables()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = pinned(docs)
            drop_tables(first, docs)  # what the stage read, and its own tables
    return docs
