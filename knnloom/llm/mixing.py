"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are put in a seeded hash order, as often as three times
(epochs); a document's virtual finish time is the source's cumulative tokens up
to it divided by the source's target.  All documents of all sources are taken
in order of finish time until the total budget is spent; the one that crosses
it is cut short.

Cumulative tokens are summed in two levels, over hash buckets of a source and
within a bucket of about BUCKET_ROWS rows, so a source that holds most rows is
spread over tasks.  Instead of sorting all items by finish time, the cut is
looked for in sums over RANGES ranges of it, then over as many inside the range
that holds it, until that one is short enough to be put in order.  These sums
and one row a source (up to MAX_SOURCES) come to the driver; documents never do.

Defined cases.  Null or wordless text: size 0, taken 0.  The null source is a
source of its own, last.  Rows with the same id and size in a source are
interchangeable; repeated rows count each.  An empty table gives an empty
result.  A null id hashes as empty text.  Ties in finish time go by source,
epoch and cumulative tokens.  Other columns pass through; input columns with the
names of the outputs are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import pinned, placed

MOST = 3
#: Rows of a source in one hash bucket, about.
BUCKET_ROWS = 2_000
#: Sources that come to the driver and are broadcast, at most; more are joined by a shuffle.
MAX_SOURCES = 100_000
#: Ranges of finish time whose sums come to the driver at a time, and items that are put in order by one task.
RANGES, LAST_ROWS = 1024, 20_000
SEED = "mix-1"


def n_words(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[int], most: int = MOST) -> list[float]:
    """Shares of the total size by weight, none above ``most`` times its size."""
    left, rest, out = sum(sizes), sum(weights), [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (most * sizes[i] / weights[i], i))
    for k, i in enumerate(order):
        if left * weights[i] > most * sizes[i] * rest:
            out[i], left, rest = float(most * sizes[i]), left - most * sizes[i], rest - weights[i]
        else:
            for j in order[k:]:
                out[j] = left * weights[j] / rest
            break
    return out


def source_table(totals: DataFrame, most_sources: int) -> tuple[DataFrame, bool]:
    """(__name, __s, __source_size, __target, __bits) of sources (source, n, rows), and whether it may be broadcast.

    Up to ``most_sources`` rows come to the driver; more are ranked and summed in order on the cluster.
    """
    bits = lambda rows: F.greatest(F.lit(0), F.least(F.lit(32), F.ceil(F.log2(rows / F.lit(BUCKET_ROWS))))).cast("int")
    got = totals.limit(most_sources + 1).collect()
    if len(got) <= most_sources:
        got.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
        size = [r["n"] for r in got]
        goal = targets(size, [i % 3 + 1 for i in range(len(size))])
        fields = [T.StructField("__name", totals.schema["source"].dataType), *(T.StructField(c, k) for c, k in (("__s", T.LongType()), ("__source_size", T.LongType()), ("__target", T.DoubleType()), ("__rows", T.LongType())))]
        table = totals.sparkSession.createDataFrame([(r["source"], i, size[i], goal[i], r["rows"]) for i, r in enumerate(got)], T.StructType(fields))
        return table.select("*", bits(F.col("__rows")).alias("__bits")).drop("__rows"), True
    big = "decimal(38,0)"
    ranked = totals.select("*", (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1).cast("long").alias("s"))
    ranked = pinned(ranked.select("*", (F.col("s") % 3 + 1).cast(big).alias("w"), F.col("n").cast(big).alias("size")))
    whole = ranked.agg(F.sum("size").alias("size"), F.sum("w").alias("w")).first()
    before = Window.orderBy((MOST * F.col("n")).cast("double") / F.col("w").cast("double"), "s").rowsBetween(Window.unboundedPreceding, -1)
    spent = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast(big)
    run = ranked.select("source", "s", "n", "rows", "w", "size", (F.lit(whole["size"]).cast(big) - MOST * spent("size")).cast(big).alias("left"), (F.lit(whole["w"]).cast(big) - spent("w")).cast(big).alias("rest"))
    run = pinned(run.select("*", (F.col("left") * F.col("w") > MOST * F.col("size") * F.col("rest")).alias("full")))
    at = run.where("NOT full").agg(F.max_by("left", "rest").alias("left"), F.max("rest").alias("rest")).first()
    share = (F.lit(at["left"]).cast(big) * F.col("w")).cast("double") / F.lit(at["rest"]).cast("double") if at["rest"] is not None else F.lit(0.0)
    target = F.when(F.col("full"), (MOST * F.col("n")).cast("double")).otherwise(share)
    return run.select(F.col("source").alias("__name"), F.col("s").alias("__s"), F.col("n").alias("__source_size"), target.alias("__target"), bits(F.col("rows")).alias("__bits")), False


def cut_of(items: DataFrame, budget: int) -> tuple | None:
    """(finish, source, epoch, cumulative tokens, words of it) of the item that crosses the budget.

    Sums over RANGES ranges of finish time come to the driver, then over as many
    of the range that holds the cut, until that range is short.
    """
    low, high, spent = 0.0, 2.0, 0
    while True:
        at = F.floor((F.col("__f") - low) * (RANGES / (high - low)))
        span = F.when(at < RANGES, at).otherwise(RANGES).alias("__range")
        inside = items.where(F.col("__f") >= low)
        sums = inside.groupBy(span).agg(F.sum("__size").alias("n"), F.count("*").alias("rows"), F.min("__f").alias("a"), F.max("__f").alias("z"))
        for r in sorted(sums.collect()):
            if spent + r["n"] >= budget:
                break
            spent += r["n"]
        else:
            return None
        if r["rows"] <= LAST_ROWS or r["a"] == r["z"]:
            break
        low, high = r["a"], math.nextafter(r["z"], math.inf)
        items = items.where(F.col("__f") <= r["z"])
    order = Window.orderBy("__f", "__s", "__e", "__cum").rowsBetween(Window.unboundedPreceding, 0)  # of one short range
    last = items.where(F.col("__f").between(r["a"], r["z"])).withColumn("__run", F.sum("__size").over(order) + spent)
    row = last.where(F.col("__run") >= budget).orderBy("__run").first()
    return row["__f"], row["__s"], row["__e"], row["__cum"], budget - (row["__run"] - row["__size"])


def mix(docs: DataFrame, source: str = "source", id_col: str = "doc_id", text: str = "text", seed: str = SEED, columns: list[str] | None = None, most_sources: int | None = None) -> DataFrame:
    """The documents with size, source_size, target, taken and whole ``copies`` taken.

    ``columns``: those of the documents to keep, all if None.  Texts are read
    once to count their words; they are joined to the answer only if kept.
    """
    keep = [c for c in (docs.columns if columns is None else columns) if c not in ("size", "source_size", "target", "taken", "copies")]
    key = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    rows = placed(docs, "__place")
    sized = pinned(rows.select("__place", F.col(id_col).alias("__id"), F.col(source).alias("__source"), n_words(F.col(text)).alias("__size"), key.alias("__key")))
    totals = sized.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("n"), F.count("*").alias("rows"))
    table, small = source_table(totals, MAX_SOURCES if most_sources is None else most_sources)
    known = sized.join(F.broadcast(table) if small else table, F.col("__source").eqNullSafe(F.col("__name")))
    known = known.withColumn("__bucket", F.expr("shiftright(cast(conv(substring(__key, 1, 8), 16, 10) as bigint), 32 - __bits)"))
    before = Window.partitionBy("__s").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = known.groupBy("__s", "__bucket").agg(F.sum("__size").alias("n")).select(F.col("__s").alias("__s2"), F.col("__bucket").alias("__b2"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    within = Window.partitionBy("__s", "__bucket").orderBy("__key", "__id", "__size").rowsBetween(Window.unboundedPreceding, 0)
    queue = known.withColumn("__run", F.sum("__size").over(within)).join(offsets, (F.col("__s") == F.col("__s2")) & (F.col("__bucket") == F.col("__b2")))
    queue = pinned(queue.select("__place", "__id", "__source", "__size", "__s", "__source_size", "__target", (F.col("__run") + F.col("__offset")).alias("__cum")))

    finish = lambda e: F.try_divide((F.col("__source_size") * e + F.col("__cum")).cast("double"), F.col("__target"))
    items = queue.where((F.col("__size") > 0) & (F.col("__target") > 0)).select("__s", "__size", "__cum", F.posexplode(F.array(*(finish(e) for e in range(MOST)))).alias("__e", "__f"))
    cut = cut_of(items, queue.agg(F.sum("__size")).first()[0] or 0)
    whole, part = F.lit(0).cast("long"), F.lit(0).cast("long")
    if cut:
        for e in range(MOST):
            at = F.struct(finish(e).alias("f"), F.col("__s").alias("s"), F.lit(e).alias("e"), F.col("__cum").alias("cum"))
            end = F.struct(F.lit(cut[0]).alias("f"), F.lit(cut[1]).cast("long").alias("s"), F.lit(cut[2]).alias("e"), F.lit(cut[3]).cast("long").alias("cum"))
            real = (F.col("__size") > 0) & (F.col("__target") > 0)
            whole = whole + F.when(real & (at < end), 1).otherwise(0)
            part = part + F.when(real & (at == end), cut[4]).otherwise(0)
    answer = [
        F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__size") * whole + part).cast("long").alias("taken"), whole.cast("int").alias("copies"),
    ]
    own = {id_col: "__id", source: "__source"}
    if all(c in own for c in keep):
        return queue.select(*(F.col(own[c]).alias(c) for c in keep), *answer)
    found = queue.select(F.col("__place").alias("__at"), *answer)
    return rows.select("__place", *(F.col(f"`{c}`") for c in keep)).join(found, F.col("__place") == F.col("__at")).drop("__place", "__at")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it was taken.  The last one is cut
    short: its taken words, joined by single spaces."""
    got = mix(docs).where("taken > 0")
    rest = F.col("taken") - F.col("copies") * F.col("size")
    none = F.array().cast("array<string>")
    words = F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    texts = F.concat(
        F.when(F.col("copies") > 0, F.array_repeat(F.col("text"), F.col("copies"))).otherwise(none),
        F.when(rest > 0, F.array(F.array_join(F.slice(words, F.lit(1), rest.cast("int")), " "))).otherwise(none),
    )
    return got.withColumn("text", F.explode(texts)).select(*(F.col(f"`{c}`") for c in docs.columns))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """What a mix of all documents takes of each; see the module for the defined cases."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs, columns=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
t AS (SELECT source, sum(size) AS n, (row_number() OVER (ORDER BY source IS NULL, source) - 1) AS s FROM d GROUP BY source),
w AS (SELECT source, n, s, s % 3 + 1 AS w, 3 * n AS cap, (SELECT sum(n) FROM t) AS total, sum(s % 3 + 1) OVER () AS ws FROM t),
o AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS cap_before, coalesce(sum(w) OVER b, 0) AS w_before FROM w
      WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (total - cap_before) * w > cap * (ws - w_before) AS capped FROM o),
f AS (SELECT min(total - cap_before) FILTER (NOT capped) AS lo_left, max(total - cap_before) FILTER (NOT capped) AS left_over, max(ws - w_before) FILTER (NOT capped) AS w_left FROM c),
g AS (SELECT source, n, s, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(left_over * w AS DOUBLE) / CAST(w_left AS DOUBLE) END AS target FROM c, f),
q AS (SELECT d.doc_id, d.size, g.n AS source_size, g.target, g.s, row_number() OVER (ORDER BY g.s, d.k, d.doc_id, d.size) AS place,
             sum(d.size) OVER (PARTITION BY g.s ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS cum
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
i AS (SELECT q.place, q.s, q.size, e, CAST(q.source_size * e + q.cum AS DOUBLE) / q.target AS f, q.cum
      FROM q, range(3) r(e) WHERE q.size > 0 AND q.target > 0),
r AS (SELECT place, size, sum(size) OVER (ORDER BY f, s, e, cum ROWS UNBOUNDED PRECEDING) - size AS before, (SELECT sum(size) FROM d) AS budget FROM i),
k AS (SELECT place, sum(greatest(0, least(size, budget - before))) AS taken FROM r GROUP BY place)
SELECT q.doc_id, q.size, CAST(q.source_size AS BIGINT) AS source_size, q.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN k USING (place)
"""
