"""Nulls, empty, very long and repeated texts, ties, clashing columns and empty tables, for each operator and stage."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from knnloom.llm.imatch import fingerprint_edits
from knnloom.llm.language import fit_codes, with_language
from knnloom.llm.media import STORED, stored_features, with_media
from knnloom.llm.mixing import mix, mixed_documents
from knnloom.llm.quality import fit_quality, with_quality
from knnloom.llm.segmentation import with_segmentations
from knnloom.llm.sharding import shuffle_shards
from knnloom.llm.simhash import near_duplicates
from knnloom.llm.suffix_dedup import with_repeats
from knnloom.llm.toxicity import fit_toxicity, with_toxicity


def by_text(df, column):
    """Values of a column by text; all equal texts must agree."""
    out = {}
    for r in df.collect():
        assert out.setdefault(r["text"], r[column]) == r[column]
    return out


def test_quality(odd, none, labels):
    model = fit_quality(odd, labels)
    got = with_quality(odd, model)
    assert got.columns.count("score") == 1 and got.count() == odd.count()
    scores = by_text(got, "score")
    assert all(0 <= s <= 1 for s in scores.values()) and scores[None] == scores[""]
    assert with_quality(none, model).count() == 0
    flat = with_quality(odd, fit_quality(none, labels))
    assert {r["score"] for r in flat.select("score").collect()} == {0.5}


def test_toxicity(odd, none, labels):
    model = fit_toxicity(odd, labels)
    scores = by_text(with_toxicity(odd, model), "score")
    assert all(0 <= s <= 1 for s in scores.values()) and scores[None] == scores[""]
    assert with_toxicity(none, model).count() == 0
    assert {r["score"] for r in with_toxicity(odd, fit_toxicity(none, labels)).select("score").collect()} == {0.5}


def test_language(odd, none):
    model = fit_codes(odd)
    got = with_language(odd, model)
    langs = by_text(got, "lang_pred")
    for text in (None, "", " \t\n ", "12345 67890 !!! ???"):
        assert langs[text] == "und"
    assert set(langs.values()) <= {"en", "fr", "de", "und"} and langs["漢字と仮名 ▁ \U0001f600 é"] != "und"
    assert {r["score"] for r in got.where("lang_pred = 'und'").collect()} == {0.0}
    assert {r["lang_pred"] for r in with_language(odd, fit_codes(none)).collect()} == {"und"}
    assert with_language(none, model).count() == 0


def test_imatch(odd, none):
    got = fingerprint_edits(odd).collect()
    assert len(got) == odd.count()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    twins = [r for r in got if r["doc_id"] == 9]
    assert len({r["fingerprint"] for r in twins}) == 1 and 1.0 in {r["near_next"] for r in twins}
    assert fingerprint_edits(none).count() == 0
    one = fingerprint_edits(odd.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0 and one[0]["next_doc_id"] == 1


def test_sharding(odd, none):
    got = shuffle_shards(odd, shards=4)
    assert sorted(got.columns) == sorted({*odd.columns, "slot"}) and got.count() == odd.count()
    assert got.exceptAll(got.select(*got.columns)).count() == 0
    assert sorted(r["n"] for r in got.groupBy("shard").agg(F.count("*").alias("n")).collect()) == [4, 4, 5, 5]
    assert shuffle_shards(none).count() == 0


def test_repeats(odd, none):
    got = with_repeats(odd)
    assert got.columns.count("spans") == 1 and got.count() == odd.count()
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in got.collect() if r["doc_id"] is not None}
    assert spans[2] == [] and spans[3] == [(33, 33 + 94)] and spans[9] == [] and spans[4] == spans[5] == []
    assert len(spans[7]) == 1 and spans[7][0][0] == 0 and spans[6] == []
    assert with_repeats(none).count() == 0


def test_near_duplicates(odd, none):
    got = near_duplicates(odd).collect()
    assert len(got) == odd.count()
    component = {r["id"]: r["component_id"] for r in got if r["id"] is not None}
    assert component[9] == 9 and component[14] == component[13] == 13 and component[4] == component[5] == component[12] == 4
    assert {r["fp"] for r in got if r["component_id"] == 4} == {0}
    assert near_duplicates(none).count() == 0
    assert {r["component_id"] for r in near_duplicates(odd.where("doc_id is null and text is not null")).collect()} == {None}


def test_mixing(odd, none):
    got = mix(odd)
    assert got.columns.count("size") == 1 and got.count() == odd.count()
    rows = got.collect()
    total = sum(r["size"] for r in rows)
    assert sum(r["taken"] for r in rows) == total and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert {r["size"] for r in rows if r["text"] in (None, "", " \t\n ")} == {0}
    again = mix(odd).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    words = [len(r["text"].split()) for r in mixed_documents(odd).collect()]
    assert sum(words) == total
    assert mix(none).count() == 0 and mixed_documents(none).count() == 0


def test_segmentation(odd, none):
    got = with_segmentations(odd, samples=3).collect()
    assert len(got) == odd.count()
    for r in got:
        if not r["text"]:
            assert [len(s["ids"]) for s in r["segmentations"]] == [0]
        else:
            assert len({tuple(s["ids"]) for s in r["segmentations"]}) == len(r["segmentations"]) >= 1
            assert len({s["decoded_crc32"] for s in r["segmentations"]}) == 1
            values = [s["value"] for s in r["segmentations"]]
            assert values == sorted(values, reverse=True)
    assert with_segmentations(none).count() == 0


def test_media(odd, none):
    udf = F.arrow_udf(stored_features, "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
    rows = odd.select("text", udf("text").alias("m")).select("text", "m.*").collect()
    for r in rows:
        n = len((r["text"] or "").encode())
        assert r["n_bytes"] == n and r["payload_bytes"] == max(576, -(-n // 576) * 576) and r["media_bytes"] == r["payload_bytes"] + 44
    assert len({tuple(r[c] for c in STORED) for r in rows if not r["text"]}) == 1
    seen = with_media(odd, "text", "source").select("media_type", "corrected", "embedded").collect()
    assert {r["media_type"] for r in seen} == {"unknown"} and not any(r["embedded"] for r in seen)
    assert with_media(none, "text").count() == 0


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, odd, none, labels, tmp_path, k):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    _, stage = corpus_pipeline.STAGES[k]
    for docs in (odd, none):
        got = stage(spark, docs, str(tmp_path))
        n = got.count()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert got.columns == docs.columns
        assert n == 0 if docs is none else n > 0
