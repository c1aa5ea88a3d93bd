"""Documents with every odd case, and an empty table."""

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, size bigint, spans string, fp string, shard int, id int, place string, term string, copies int"
PASSAGE = "a passage of well over fifty bytes that several of the documents have in common, word for word"


def rows():
    long = " ".join(f"word{i % 977} item{i % 31}" for i in range(40_000))
    texts = [
        (1, "The quick brown fox jumps over the lazy dog. " * 3, "en", "a"), (2, PASSAGE + " and then an ending of its own", "en", "a"), (3, "something quite different first; " + PASSAGE, "en", "b"),
        (4, "", "fr", "b"), (5, None, "fr", None), (None, "une phrase sans identifiant, mais avec des lettres", "fr", "b"), (None, None, None, None), (6, long, "en", "c"), (7, long + " tail", "en", "c"),
        (8, "12345 67890 !!! ???", None, "a"), (9, "même chose, deux fois, naïve café", "fr", "a"), (9, "même chose, deux fois, naïve café", "fr", "a"), (10, "x", "de", "a"), (11, "die Straße und der große Bär | § 5", "de", ""),
        (12, " \t\n ", "de", "b"), (13, "a b c", "en", "b"), (14, "a b c", "en", "b"), (15, "漢字と仮名 ▁ \U0001f600 é", "en", "a"),
    ]
    return [(i, t, g, s, None if t is None else len(t), 0.5, 3, "spans", "fp", 9, 7, "here", "term", 2) for i, t, g, s in texts]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


@pytest.fixture(scope="session")
def labels(spark):
    some = [(i, i % 2, (i // 2) % 2) for i in (1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 13)]
    return spark.createDataFrame([*some, (None, 1, 1), (8, None, None), (1, 1, 0), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
