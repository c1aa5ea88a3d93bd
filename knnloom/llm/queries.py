"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .clustering import OP11_SQL, op11_clustering
from .imatch import OP1_SQL, op1_imatch
from .infilling import OP12_SQL, op12_infilling
from .interpolation import op13_interpolation
from .language import op7_language
from .media import op9_media
from .mixing import OP8_SQL, op8_mixing
from .quality import op10_quality
from .segmentation import op3_segmentation
from .sharding import op4_sharding
from .simhash import op6_simhash
from .suffix_dedup import op5_suffix_dedup
from .toxicity import op2_toxicity


def sharding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op4: rows, bytes and slots of the shards."""
    slots = op4_sharding(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("n_rows"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.countDistinct("slot").alias("n_slots"), F.sum("size").alias("n_bytes"))
    return slots.withColumn("all_bytes", F.sum("n_bytes").over(Window.partitionBy())).drop("n_bytes")  # 24 rows


def media_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op9: sizes and digests, without the checksum and the features."""
    return op9_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes", "media_sha256")


def lm_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op13: tokens and the score by single tokens, to six decimals."""
    return op13_interpolation(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_imatch": op1_imatch,
    "op2_toxicity": op2_toxicity,
    "op3_segmentation": op3_segmentation,
    "op4_sharding": op4_sharding,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_simhash": op6_simhash,
    "op7_language": op7_language,
    "op8_mixing": op8_mixing,
    "op9_media": op9_media,
    "op10_quality": op10_quality,
    "op11_clustering": op11_clustering,
    "op12_infilling": op12_infilling,
    "op13_interpolation": op13_interpolation,
    "lm_counts": lm_counts,
    "sharding_counts": sharding_counts,
    "media_digests": media_digests,
}
#: Every window of 50 bytes (as hex) with the smallest id that has it, then gaps and islands.
OP5_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 100) AS s FROM (SELECT doc_id, h, unnest(range(n - 49)) AS i FROM d WHERE n >= 50)),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
k AS (SELECT DISTINCT w.doc_id, w.i FROM w JOIN m USING (s) WHERE m.first < w.doc_id),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM k),
r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY doc_id, run),
p AS (SELECT doc_id, run, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
c AS (SELECT p.doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS last, string_agg(substr(d.h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS kept FROM p JOIN d USING (doc_id) GROUP BY p.doc_id)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(c.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(c.spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(c.kept, '') || substr(d.h, CAST(2 * coalesce(c.last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""
SHARDING_COUNTS_SQL = """
WITH n AS (SELECT count(*) AS n, CAST(sum(octet_length(encode(coalesce(text, ''))) + 8) AS BIGINT) AS b FROM documents),
s AS (SELECT CAST(i AS INTEGER) AS shard, CAST(n // 24 + (CASE WHEN i < n % 24 THEN 1 ELSE 0 END) AS BIGINT) AS k, b FROM n, range(24) r(i))
SELECT shard, k AS n_rows, CAST(0 AS BIGINT) AS first_slot, k - 1 AS last_slot, k AS n_slots, b AS all_bytes FROM s WHERE k > 0
"""
#: The 44 bytes of a WAV file's head in hex, with its two lengths as little-endian numbers.
MEDIA_DIGESTS_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
p AS (SELECT *, greatest(1, CAST(ceil(n / 576e0) AS BIGINT)) * 576 AS m FROM d),
q AS (SELECT *, h || repeat('FF', m - n) AS payload, printf('%08X', m + 36) AS a, printf('%08X', m) AS z FROM p),
w AS (SELECT *, '52494646' || substr(a, 7, 2) || substr(a, 5, 2) || substr(a, 3, 2) || substr(a, 1, 2) || '57415645666D74201000000001000100401F0000401F00000100080064617461'
             || substr(z, 7, 2) || substr(z, 5, 2) || substr(z, 3, 2) || substr(z, 1, 2) || payload AS stored FROM q)
SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(unhex(payload)) AS payload_sha256, m + 44 AS media_bytes, sha256(unhex(stored)) AS media_sha256 FROM w
"""
#: The remainder is of a CRC-32 by its table; a text's last token is null.
LM_COUNTS_SQL = """
WITH tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS s, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
f AS MATERIALIZED (SELECT r, doc_id, t, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(s) + 1), lambda p: CAST(ord(s[p]) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 2 AS held_out FROM d, tab),
w AS MATERIALIZED (SELECT r, held_out, unnest(list_append(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'), NULL)) AS w FROM f),
c AS (SELECT w, count(*) AS c FROM w WHERE NOT held_out GROUP BY w), n AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS v FROM c)
SELECT f.doc_id, any_value(f.held_out) AS held_out, count(*) AS n_tokens, count(c.c) AS n_known, any_value(n.n) AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 1) / CAST(n.n + n.v + 1 AS DOUBLE))), 6) AS base_score
FROM f JOIN w USING (r) CROSS JOIN n LEFT JOIN c ON c.w IS NOT DISTINCT FROM w.w GROUP BY f.r, f.doc_id
"""
ORACLE_SQL: dict[str, str] = {"op1_imatch": OP1_SQL, "op5_suffix_dedup": OP5_SQL, "op8_mixing": OP8_SQL, "op11_clustering": OP11_SQL, "op12_infilling": OP12_SQL, "lm_counts": LM_COUNTS_SQL, "sharding_counts": SHARDING_COUNTS_SQL, "media_digests": MEDIA_DIGESTS_SQL}
