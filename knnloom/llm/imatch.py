"""I-Match document fingerprints, in DataFrame functions only.

Terms are lower-cased runs of letters and digits.  The lexicon keeps the terms
whose document frequency, counted over distinct texts, lies in a band of inverse
document frequency; each of SUBSETS random subsets of it keeps a term with a
chance between 1/2 and 1/256.  A fingerprint has for each subset the hash of the
document's distinct terms in it, sorted.  The likeness of two fingerprints is the
share of equal hashes among the subsets in which either has a term.

Copies of a text count once, so a text that is copied a million times keeps its
rare terms: a document brings each term the share 1 / (copies of its text), summed
exactly by number of copies.  A term in the band is in LEAST_SHARE of all texts at
least, so the lexicon has at most (mean distinct terms of a text) / LEAST_SHARE
terms at any size of the corpus.  Up to BROADCAST_TERMS of them travel with the
plan as a table of their hashes (64 bits, in buckets), and a row's terms are looked
up within the row; more are joined by term.

Defined cases.  A null text is empty.  A text without lexicon terms has as
fingerprint the digest of the whole text, which is like itself only.  Documents
stand in the order of id (null first), then of hashes of the content; repeated
rows follow each other.  A single document is its own next.  An empty table
gives an empty result.  Very long texts are read whole.  Of the input only id
and text are read, whatever other columns there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import pinned

#: A lexicon term is in this share of all distinct texts at least, and at most.
LEAST_SHARE, MOST_SHARE = 0.002, 0.02
SUBSETS, RATES = 32, 8
BROADCAST_TERMS = 200_000
#: Texts with copies that are broadcast, with their numbers (16 bytes each), at most; more are joined by a shuffle.
BROADCAST_COPIES = 1_000_000
SEED = 3
#: The hash of no terms: the first digits of the MD5 of an empty text.
EMPTY = "d41d8cd9"


def terms(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), ""))


def _digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), F.lit(SEED))


def document_frequencies(docs: DataFrame, text: str = "text", copied: DataFrame | None = None, broadcast: bool = True) -> DataFrame:
    """(term, df) over all distinct texts; ``copied`` has (digest, copies) of those that occur more than once."""
    rows = docs.select(F.col(text).alias("text"))
    if copied is None:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    else:
        copied = copied.select(F.col("digest").alias("__digest"), F.col("copies").alias("__copies"))
        rows = rows.join(F.broadcast(copied) if broadcast else copied, _digest(F.col("text")) == F.col("__digest"), "left").select("text", F.coalesce("__copies", F.lit(1).cast("long")).alias("copies"))
    found = rows.select(F.explode(terms(F.col("text"))).alias("term"), "copies").groupBy("term", "copies").agg(F.count("*").alias("n"))
    return found.groupBy("term").agg(F.sum(F.expr("n div copies")).alias("df"))


def subset_bits(term: Column) -> Column:
    """A bit for each subset that holds the term: of RATES subsets of a draw, each has half the terms of the one before."""
    bits = F.lit(0).cast("long")
    for draw in range(SUBSETS // RATES):
        h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED + draw}|"), term).cast("binary")), 1, 4), 16, 10).cast("long").bitwiseOR(F.lit(1 << RATES))
        bits = bits + F.shiftleft(h.bitwiseAND(-h) - 1, RATES * draw)
    return bits


def lexicon(docs: DataFrame, text: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE, broadcast_copies: int | None = None) -> DataFrame:
    """(term, subsets): the terms in the band, with a bit for each subset that holds the term."""
    texts = pinned(docs.groupBy(_digest(F.col(text)).alias("digest")).agg(F.count("*").alias("copies")), "none")
    copied = texts.where("copies > 1")
    n, again = texts.count(), copied.count()
    few = again <= (BROADCAST_COPIES if broadcast_copies is None else broadcast_copies)
    keep = document_frequencies(docs, text, copied if again else None, few).where((F.col("df") >= max(2, least * n)) & (F.col("df") <= max(2, most * n)))
    return pinned(keep.select("term", subset_bits(F.col("term")).alias("subsets")), "none")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets that are not empty in both."""
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda i: F.substring(s, i * 8 + 1, F.lit(8)))
    used = F.filter(F.arrays_zip(cut(a).alias("x"), cut(b).alias("y")), lambda p: (p["x"] != EMPTY) | (p["y"] != EMPTY))
    same = F.size(F.filter(used, lambda p: p["x"] == p["y"]))
    plain = a.startswith("=") | b.startswith("=")
    return F.when(a == b, 1.0).when(plain | (F.size(used) == 0), 0.0).otherwise(same / F.size(used)).cast("double")


def _print(found: Column, digest: Column) -> Column:
    """The fingerprint of sorted lexicon terms (term, subsets), or the digest where there are none."""

    def draw(found: Column, d: int) -> Column:  # each subset holds the next of its draw, so terms are looked at until they drop out
        inside = lambda terms_, k: F.filter(terms_, lambda x: F.call_function("shiftright", x["subsets"], F.lit(RATES * d) + k).bitwiseAND(1) == 1)
        hashed = lambda terms_: F.substring(F.md5(F.array_join(F.transform(terms_, lambda x: x["term"]), " ").cast("binary")), 1, 8)
        first = F.struct(inside(found, F.lit(0)).alias("left"), F.lit("").alias("out"))
        step = lambda acc, k: F.struct(inside(acc["left"], k).alias("left"), F.concat(acc["out"], hashed(acc["left"])).alias("out"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(RATES)), first, step, lambda acc: acc["out"])

    # as the argument of a lambda the sorted terms are made once, not for each draw
    whole = F.element_at(F.transform(F.array(found), lambda f: F.when(F.size(f) > 0, F.concat(*(draw(f, d) for d in range(SUBSETS // RATES))))), 1)
    return F.coalesce(whole, F.concat(F.lit("="), digest))


def with_fingerprints(rows: DataFrame, keys: list[str], texts: dict[str, str], words: DataFrame, broadcast_terms: int | None = None) -> DataFrame:
    """Fingerprints of several text columns at once; ``texts`` names their outputs, in whose place the texts go.

    ``keys`` tell rows apart.
    """
    rest = [c for c in rows.columns if c not in texts]
    most = BROADCAST_TERMS if broadcast_terms is None else broadcast_terms
    if words.count() <= most:
        known = words.select(F.xxhash64("term").alias("h"), "subsets").collect()
        size = 1 << max(4, (2 * len(known)).bit_length())
        buckets: list[dict[int, int]] = [{} for _ in range(size)]
        for r in known:
            buckets[r["h"] % size][r["h"]] = r["subsets"]
        table = rows.sparkSession.createDataFrame([(buckets,)], "buckets array<map<bigint,bigint>>").scalar()
        bucket = lambda t: F.get(F.col("__lexicon"), F.pmod(F.xxhash64(t), F.lit(size)).cast("int"))
        of = lambda t: F.struct(t.alias("term"), F.element_at(bucket(t), F.xxhash64(t)).alias("subsets"))
        # one reference to the table, so that the optimizer puts the subquery's value there and no row carries it
        found = F.transform(F.array(*(terms(F.col(c)) for c in texts)), lambda ts: F.sort_array(F.filter(F.transform(ts, of), lambda x: x["subsets"].isNotNull())))
        got = rows.withColumn("__lexicon", table).select(*rest, *texts, found.alias("__found"))
        return got.select(*rest, *(_print(F.col("__found")[i], F.md5(F.col(c).cast("binary"))).alias(name) for i, (c, name) in enumerate(texts.items())))
    of_text = lambda i: lambda t: F.struct(F.lit(i).alias("which"), t.alias("term"))
    pairs = rows.select(*keys, F.explode(F.concat(*(F.transform(terms(F.col(c)), of_text(i)) for i, c in enumerate(texts)))).alias("p")).select(*keys, "p.*")
    in_text = lambda i: F.sort_array(F.collect_list(F.when(F.col("which") == i, F.struct("term", "subsets"))))
    held = pairs.join(words.hint("shuffle_hash"), "term").groupBy(*keys).agg(*(in_text(i).alias(f"__found{i}") for i in range(len(texts))))
    none = F.array().cast("array<struct<term:string,subsets:bigint>>")
    joined = rows.join(held, keys, "left")
    return joined.select(*rest, *(_print(F.coalesce(F.col(f"__found{i}"), none), F.md5(F.col(c).cast("binary"))).alias(name) for i, (c, name) in enumerate(texts.items())))


def neighbours(docs: DataFrame) -> DataFrame:
    """(k1, k2, copies, next, prev): each distinct (id, text) with those around it in order of id.

    Ordered in ranges of id; what follows the last of a range comes from the
    first of the next, one row a range.
    """
    own = F.struct("k1", "k2", "n")
    groups = docs.groupBy("id", "k1", "k2", "n").agg(F.count("*").alias("copies"))
    ranged = pinned(groups.repartitionByRange("id", "k1", "k2").withColumn("pid", F.spark_partition_id()), "none")
    ends = ranged.groupBy("pid").agg(F.min(F.struct("id", "k1", "k2", "n")).alias("a"), F.max(F.struct("id", "k1", "k2", "n")).alias("z"))
    by, all_ = Window.orderBy("pid"), Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("pid", F.coalesce(F.lead("a").over(by), F.first("a").over(all_)).alias("after"), F.coalesce(F.lag("z").over(by), F.last("z").over(all_)).alias("before"))
    cut = lambda c: F.struct(F.col(f"{c}.k1").alias("k1"), F.col(f"{c}.k2").alias("k2"), F.col(f"{c}.n").alias("n"))
    w = Window.partitionBy("pid").orderBy("id", "k1", "k2")
    inside = ranged.select("pid", "k1", "k2", "copies", F.lead(own).over(w).alias("next"), F.lag(own).over(w).alias("prev"))
    return inside.join(F.broadcast(ends), "pid").select("k1", "k2", "copies", F.coalesce("next", cut("after")).alias("next"), F.coalesce("prev", cut("before")).alias("prev"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's and its edited text's fingerprints, and their likenesses.

    Edited: the last quarter of the code points gives way to the beginning of
    the next document.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.select("id", "text", F.xxhash64("id", "text").alias("k1"), F.xxhash64("text", F.lit(SEED)).alias("k2"), F.length("text").alias("n"))
    words = lexicon(base)
    order = pinned(neighbours(base.select("id", "k1", "k2", "n")), "none")
    copy = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.lit(1)))
    rows = base.withColumn("copy", copy).join(order, ["k1", "k2"])
    # The beginning of a document goes to the one before it; any copy has the same.  Both sides of
    # the join below need the same columns of all texts, so these are shuffled once and reused; the
    # difference keeps the condition from becoming a key of one more shuffle.
    heads = rows.where("copies - copy = 0").select(
        F.col("prev.k1").alias("k1"), F.col("prev.k2").alias("k2"), F.expr("substring(text, 1, cast(floor(prev.n / 4) as int))").alias("head"), F.col("id").alias("next_id"), F.col("n").alias("next_n"),
    )
    cut = F.floor(F.col("n") / 4).cast("int")
    last = F.col("copy") == F.col("copies")
    head = F.when(last, F.col("head")).otherwise(F.expr("substring(text, 1, cast(floor(n / 4) as int))"))
    edited = rows.join(heads, ["k1", "k2"]).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n") - cut), head))
    to = F.when(last, F.struct(F.col("next.k1").alias("k1"), F.col("next.k2").alias("k2"))).otherwise(F.struct("k1", "k2"))
    keyed = edited.select(
        "k1", "k2", "copy", "id", "n", to.alias("to"), F.when(last, F.col("next_id")).otherwise(F.col("id")).alias("next_id"), F.when(last, F.col("next_n")).otherwise(F.col("n")).alias("next_n"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "text", "edited",
    )
    prints = pinned(with_fingerprints(keyed, ["k1", "k2", "copy"], {"text": "fingerprint", "edited": "edited_fingerprint"}, words))
    other = prints.where("copy = 1").select(F.col("k1").alias("o1"), F.col("k2").alias("o2"), F.col("fingerprint").alias("next_fingerprint"))
    both = prints.join(other, (F.col("to.k1") == F.col("o1")) & (F.col("to.k2") == F.col("o2")))
    return both.select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        F.col("next_id").alias(f"next_{id_col}"), F.col("next_n").cast("long").alias("next_n_chars"),
    )


def op1_imatch(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their edited texts; see the module for the defined cases."""
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
e AS (SELECT doc_id, text, n, coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS next_doc_id,
             coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next_text FROM d),
x AS (SELECT *, substr(text, 1, n - n // 4) || substr(next_text, 1, n // 4) AS edited FROM e),
w AS (SELECT doc_id, 0 AS which, unnest(list_distinct(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'))) AS term FROM x
      UNION ALL SELECT doc_id, 1, unnest(list_distinct(regexp_split_to_array(lower(edited), '[^\\p{{L}}\\p{{N}}]+'))) FROM x),
u AS (SELECT DISTINCT text FROM d),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'))) AS term FROM u) WHERE term <> '' GROUP BY term),
n AS (SELECT count(*) AS n FROM u),
lex AS (SELECT term FROM df, n WHERE df >= greatest(2, {LEAST_SHARE}::DOUBLE * n) AND df <= greatest(2, {MOST_SHARE}::DOUBLE * n)),
sub AS (SELECT term, k FROM lex, range({SUBSETS}) r(k)
        WHERE CAST('0x' || substr(md5(CAST({SEED} + k // {RATES} AS VARCHAR) || '|' || term), 1, 4) AS INTEGER) % (1 << CAST(k % {RATES} + 1 AS INTEGER)) = 0),
h AS (SELECT w.doc_id, w.which, sub.k, substr(md5(string_agg(w.term, ' ' ORDER BY w.term)), 1, 8) AS h FROM w JOIN sub USING (term) GROUP BY w.doc_id, w.which, sub.k),
has AS (SELECT DISTINCT doc_id, which FROM w JOIN lex USING (term)),
f AS (SELECT has.doc_id, has.which, string_agg(coalesce(h.h, '{EMPTY}'), '' ORDER BY r.k) AS f, list(coalesce(h.h, '{EMPTY}') ORDER BY r.k) AS hs
      FROM has CROSS JOIN range({SUBSETS}) r(k) LEFT JOIN h ON h.doc_id = has.doc_id AND h.which = has.which AND h.k = r.k GROUP BY has.doc_id, has.which),
p AS (SELECT x.*, coalesce(a.f, '=' || md5(x.text)) AS fa, coalesce(b.f, '=' || md5(x.edited)) AS fb, a.hs AS ha, b.hs AS hb
      FROM x LEFT JOIN f a ON a.doc_id = x.doc_id AND a.which = 0 LEFT JOIN f b ON b.doc_id = x.doc_id AND b.which = 1),
q AS (SELECT p.*, o.fa AS fn, o.ha AS hn, o.n AS next_n FROM p JOIN p o ON o.doc_id = p.next_doc_id),
z AS (SELECT *, list_filter(range({SUBSETS}), lambda k: ha[k + 1] <> '{EMPTY}' OR hb[k + 1] <> '{EMPTY}') AS ue, list_filter(range({SUBSETS}), lambda k: ha[k + 1] <> '{EMPTY}' OR hn[k + 1] <> '{EMPTY}') AS un FROM q)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, fa AS fingerprint, fb AS edited_fingerprint,
       CASE WHEN fa = fb THEN 1e0 WHEN ha IS NULL OR hb IS NULL OR len(ue) = 0 THEN 0e0 ELSE CAST(len(list_filter(ue, lambda k: ha[k + 1] = hb[k + 1])) AS DOUBLE) / len(ue) END AS near_edited,
       CASE WHEN fa = fn THEN 1e0 WHEN ha IS NULL OR hn IS NULL OR len(un) = 0 THEN 0e0 ELSE CAST(len(list_filter(un, lambda k: ha[k + 1] = hn[k + 1])) AS DOUBLE) / len(un) END AS near_next,
       next_doc_id, CAST(next_n AS BIGINT) AS next_n_chars
FROM z
"""
