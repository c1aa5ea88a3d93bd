"""Copies don't push a text's terms out of the lexicon, and large tables take the other way with the same answer."""

from pyspark.sql import functions as F

from knnloom.llm import imatch

from ..conftest import DATA

SMALL = f"{DATA}/sf0.001"


def test_copies_leave_the_lexicon_as_it_is(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    one = docs.where(F.length("text") > 1000).orderBy("doc_id").limit(1)
    crowd = docs.unionByName(one.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(300)))).select((F.col("n") + 10**6).alias("doc_id"), "text"))
    words = [{r["term"] for r in imatch.lexicon(d).collect()} for d in (docs, crowd)]
    assert words[0] == words[1]
    assert {r["term"] for r in imatch.lexicon(crowd, broadcast_copies=0).collect()} == words[0]
    own = one.select(F.explode(imatch.terms(F.col("text"))).alias("t")).where(F.col("t").isin(list(words[0]))).count()
    assert own > 0
    got = imatch.fingerprint_edits(crowd).where("doc_id > 1000000").select("fingerprint").distinct().collect()
    assert len(got) == 1 and not got[0][0].startswith("=")


def test_terms_are_joined_where_they_are_many(spark, odd, none):
    base = odd.select(F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("k"), F.lit("more words").alias("other"))
    words = imatch.lexicon(base, most=1.0, least=0.0)
    assert words.count() > 5
    texts = {"text": "a", "other": "b"}
    few, many = (sorted(map(tuple, imatch.with_fingerprints(base, ["k"], texts, words, broadcast_terms=n).select("k", "a", "b").collect())) for n in (None, 0))
    assert few == many and any(not r[1].startswith("=") for r in few) and any(r[1].startswith("=") for r in few)


def test_subset_bits(spark):
    words = ["a", "term", "étoile", "x1"]
    got = {r["w"]: r["b"] for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", imatch.subset_bits(F.col("w")).alias("b")).collect()}
    import hashlib

    for w in words:
        want = 0
        for k in range(imatch.SUBSETS):
            h = int(hashlib.md5(f"{imatch.SEED + k // imatch.RATES}|{w}".encode()).hexdigest()[:4], 16)
            want |= (h % (1 << (k % imatch.RATES + 1)) == 0) << k
        assert got[w] == want
