"""Folds, labelled rows and the bounded samples that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows are broadcast to the texts only up to this many (16 bytes each).
BROADCAST_ROWS = 2_000_000


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, mod n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def sample_labels(labels: DataFrame, label: str, folds: int, held_out: int, rows: int) -> DataFrame:
    """(doc_id, y) of at most ``rows`` rows of each label outside the held-out fold.

    The rows with the smallest seeded hash of the id are taken, so the sample is
    the same in every run.  Rows with a null id or label are left out; of
    repeated ids the largest label counts.
    """
    use = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("y"))
    )
    parts = [use.where(F.col("y") == y).orderBy(F.xxhash64(F.col("doc_id"), F.lit(11)), "doc_id").limit(rows) for y in (0, 1)]
    return parts[0].unionByName(parts[1])
