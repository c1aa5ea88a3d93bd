"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters records uniformly, by a seeded hash of id and place, into
buckets of about ``bucket_bytes``.  Pass two makes a Fisher-Yates shuffle of each
bucket (``shuffle`` of the array of its row numbers), reads the bucket's records
in order of place against it, and deals them out to the shards in turn.  A
bucket's first number is the count of records before it, so the counts of shards
differ by one at most.

Held in memory are the row numbers of one bucket; its records stream by.  The
hash takes the place (file and row, see ``session.placed``), so repeated rows
scatter like others, no bucket outgrows memory, and the shards depend on the
files and the seed only, not on partitions or cores.

Defined cases.  A null text has size 8 and checksum 0.  Null ids and repeated
rows are records like others.  An empty table gives no records.  Records that
are longer than a bucket fill one alone.  All columns are kept; input columns
named as the outputs are replaced, and names that begin with ``__`` are not for
input columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import pinned, placed

SHARDS = 24
BUCKET_BYTES = 16 << 20
#: Tasks that shuffle the row numbers of buckets, at most.
SHUFFLERS = 1000
FILE_ROWS = 1_000_000
SEED = 20


def record_size(text: str = "text"):
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 8).cast("long")


def shuffle_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The records with ``shard`` (0 to shards-1) and gapless ``slot``, in shuffled order."""
    keep = [c for c in docs.columns if c not in ("shard", "slot")]
    total = docs.agg(F.sum(record_size(text))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    rows = placed(docs.select(*(F.col(f"`{c}`") for c in keep)), "__place")
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col("__place")), F.lit(buckets)).cast("long"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(F.col("__bucket").alias("__b")).agg(F.count("*").cast("int").alias("__n"))
    first = counts.select("__b", "__n", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    # shuffle() draws by the number of its partition: so many partitions, dealt by bucket and sorted, at any size of cluster.
    # Written down, as the join would else deal the records out like these.
    dealt = first.repartition(min(buckets, SHUFFLERS), "__b").sortWithinPartitions("__b").select("__b", "__first", F.shuffle(F.sequence(F.lit(0), F.col("__n") - 1), seed).alias("__to"))
    dealt = pinned(dealt, "none")
    numbered = rows.withColumn("__number", F.row_number().over(Window.partitionBy("__bucket").orderBy("__place")))
    at = F.col("__first") + F.element_at("__to", F.col("__number"))
    return numbered.join(dealt, F.col("__bucket") == F.col("__b")).select(*(F.col(f"`{c}`") for c in keep), (at % shards).cast("int").alias("shard"), F.floor(at / shards).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, file_rows: int = FILE_ROWS, **options) -> None:
    """Writes the shards as folders shard=N, in order of slot, in files of ``file_rows`` slots."""
    out = shuffle_shards(docs, **options)
    block = F.floor(F.col("slot") / file_rows)
    out.repartition("shard", block).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal counts; see the module for the defined cases."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = shuffle_shards(docs)
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    return out.select("doc_id", record_size().alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
