"""The rows of op3 hold the segmentations themselves."""

from knnloom.llm import queries, segmentation

from ..conftest import DATA

SMALL = f"{DATA}/sf0.001"


def test_ids_give_the_text_back(spark):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.QUERIES["op3_segmentation"](spark, SMALL).collect()
    assert len(got) == len(text)
    for r in got:
        assert [len(x) for x in r["ids"]] == r["n_pieces"] and len(r["ids"]) == r["n_samples"] == len(r["logp"])
        assert all(segmentation.decode(x) == text[r["doc_id"]].encode() for x in r["ids"])


def test_keys_of_any_type(spark):
    rows = spark.createDataFrame([("a", "some words here"), ("b", "some words here"), ("a", "some words here"), (None, "x"), (None, None)], "name string, text string")
    got = segmentation.with_segmentations(rows, "name", samples=4)
    assert got.columns == ["name", "text", "segmentations"]
    seen = {}
    for r in got.collect():
        ids = [tuple(s["ids"]) for s in r["segmentations"]]
        assert seen.setdefault((r["name"], r["text"]), ids) == ids
    assert seen["a", "some words here"] != seen["b", "some words here"]
