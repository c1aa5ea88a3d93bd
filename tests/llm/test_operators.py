"""Each operator against brute force, a round trip, exact probabilities or held-out accuracy."""

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from knnloom.llm import imatch, media, mixing, queries, segmentation, simhash, suffix_dedup, suffixes
from knnloom.llm import textbytes as tb

from ..conftest import DATA

SMALL, MID = f"{DATA}/sf0.001", f"{DATA}/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()]


# kernels


def test_words_and_hashes():
    texts = ["Ab  ab\tcd", "", "x", " y ", "ab"]
    data, off = tb.column_bytes(pa.array(texts))
    s, e, p = tb.words(data, off)
    got = [(int(k), bytes(data[a:b])) for a, b, k in zip(s, e, p, strict=True)]
    assert got == [(i, w.encode()) for i, t in enumerate(texts) for w in t.split()]
    h = tb.span_hashes(data, s, e)
    assert h[0] == h[1] == h[5] and len(set(h.tolist())) == 4


def test_slices_cover_everything():
    texts = ["word " * 3000, "", None, "short", "y" * 9000]
    for whole in (False, True):
        parts = {}
        for data, off, rows in tb.slices(pa.array(texts), 5000, whole):
            for k, r in enumerate(rows.tolist()):
                parts[r] = parts.get(r, b"") + bytes(data[off[k] : off[k + 1]])
                assert whole or off[k + 1] - off[k] <= 5000
        assert [parts.get(i, b"").decode() for i in range(5)] == [t or "" for t in texts]


# 1


def test_imatch(spark, docs):
    got = {r["doc_id"]: r for r in queries.QUERIES["op1_imatch"](spark, SMALL).collect()}
    assert len(got) == len(docs)
    for k, (i, text, _) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        n = len(text) // 4
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256((text[: len(text) - n] + after[:n]).encode()).hexdigest()
        assert got[i]["near_edited"] == likeness(got[i]["fingerprint"], got[i]["edited_fingerprint"])
        assert got[i]["near_next"] == likeness(got[i]["fingerprint"], got[docs[(k + 1) % len(docs)][0]]["fingerprint"])
    by_text = {}
    for i, text, _ in docs:
        assert by_text.setdefault(text, got[i]["fingerprint"]) == got[i]["fingerprint"]
    assert np.mean([r["near_edited"] for r in got.values()]) > 5 * np.mean([r["near_next"] for r in got.values()])


def likeness(a, b):
    if a == b:
        return 1.0
    if a[0] == "=" or b[0] == "=":
        return 0.0
    cut = lambda s: [s[k : k + 8] for k in range(0, len(s), 8)]
    used = [(x, y) for x, y in zip(cut(a), cut(b), strict=True) if (x, y) != (imatch.EMPTY,) * 2]
    return sum(x == y for x, y in used) / len(used) if used else 0.0


def test_lexicon_and_fingerprint(spark, docs):
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    terms = {i: {w for w in re.split(r"[^^\W_]+(?<![\w])|[\W_]+", t.lower()) if w} for i, t, _ in docs}
    df, distinct = {}, {t: terms[i] for i, t, _ in docs}  # copies of a text count once
    for ts in distinct.values():
        for w in ts:
            df[w] = df.get(w, 0) + 1
    n = len(distinct)
    want = {w for w, c in df.items() if max(2, imatch.LEAST_SHARE * n) <= c <= max(2, imatch.MOST_SHARE * n)}
    lexicon = {r["term"]: r["subsets"] & 0xFFFFFFFF for r in imatch.lexicon(frame).collect()}
    assert set(lexicon) == want
    got = {r["doc_id"]: r["fingerprint"] for r in imatch.fingerprint_edits(frame).select("doc_id", "fingerprint").collect()}
    for i, text, _ in docs:
        own = sorted(terms[i] & want)
        if not own:
            assert got[i] == "=" + hashlib.md5(text.encode()).hexdigest()
            continue
        assert got[i] == "".join(hashlib.md5(" ".join(w for w in own if lexicon[w] >> k & 1).encode()).hexdigest()[:8] for k in range(32))


# 2, 7, 10


@pytest.mark.parametrize(("name", "label", "least"), [("op2_toxicity", "toxic", 0.6), ("op10_quality", "quality", 0.97)])
def test_held_out_labels(spark, name, label, least):
    got = queries.QUERIES[name](spark, MID)
    assert got.count() == 1000
    both = got.join(spark.read.parquet(f"{MID}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert set(both["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5)) == {0}
    rank, y = both["score"].rank(), both[label] == 1
    assert (rank[y].mean() - (y.sum() + 1) / 2) / (~y).sum() >= least


def test_held_out_languages(spark):
    got = queries.QUERIES["op7_language"](spark, MID).join(spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert set(got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4)) == {2}
    assert (got["lang"] == got["lang_pred"]).mean() > 0.98


# 3


def test_segmentations_decode(docs):
    got = segmentation.sample_segmentations(np.array([d[0] for d in docs]), pa.array([d[1] for d in docs]))
    for (_, text, _), samples in zip(docs, got, strict=True):
        assert all(segmentation.decode(s[0]) == text.encode() for s in samples)
        assert len({tuple(s[0]) for s in samples}) == len(samples) == segmentation.SAMPLES


def test_segmentation_is_seeded_by_row():
    one = segmentation.sample_segmentations(np.array([5, 6]), pa.array(["there is text", "there is text"]), samples=4)
    two = segmentation.sample_segmentations(np.array([6, 5]), pa.array(["there is text", "there is text"]), samples=4)
    assert [tuple(s[0]) for s in one[0]] == [tuple(s[0]) for s in two[1]]


def test_sampling_is_without_replacement_and_unbiased():
    n, text, alpha = 20_000, "the there", 0.25
    vocab = segmentation.vocabulary(segmentation.MODEL, alpha)
    exact = {}

    def walk(rest, ids, w):
        if not rest:
            exact[tuple(ids)] = w
        for size in range(1, len(rest) + 1):
            h = 0
            for b in rest[:size]:
                h = (h * int(segmentation._BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
            piece = int(vocab.find(np.array([h], np.uint64))[0])
            if piece >= 0:
                walk(rest[size:], [*ids, piece], w * np.exp(vocab.weight[piece]))

    walk(b" " + text.encode(), [], 1.0)
    total = sum(exact.values())
    exact = {k: w / total for k, w in exact.items()}
    got = segmentation.sample_segmentations(np.arange(n), pa.array([text] * n), samples=3, alpha=alpha)
    first, pairs, weight = {}, {}, 0.0
    for row in got:
        ids = [tuple(s[0].tolist()) for s in row]
        assert len(set(ids)) == 3
        first[ids[0]] = first.get(ids[0], 0) + 1
        pairs[ids[0], ids[1]] = pairs.get((ids[0], ids[1]), 0) + 1
        for k, s in zip(ids, row, strict=True):
            assert s[1] == pytest.approx(np.log(exact[k]), abs=1e-9)
        weight += sum(np.exp(s[1]) / s[3] for s in row)
    for k in sorted(exact, key=exact.get)[-5:]:
        assert first.get(k, 0) / n == pytest.approx(exact[k], abs=5 * np.sqrt(exact[k] / n))
    for (a, b), c in sorted(pairs.items(), key=lambda x: -x[1])[:5]:
        p = exact[a] * exact[b] / (1 - exact[a])
        assert c / n == pytest.approx(p, abs=5 * np.sqrt(p / n))
    assert weight / n == pytest.approx(1, abs=0.03)


# 4


def test_shards(spark, docs):
    got = queries.QUERIES["op4_sharding"](spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in got) == [d[0] for d in docs]
    text = {d[0]: d[1].encode() for d in docs}
    slots = {}
    for r in got:
        assert r["size"] == len(text[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) and r["law"] == "rows"
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(slots) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["slot"] * 24 + r["shard"])]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.3


# 5


def test_induced_sorting():
    rng = np.random.default_rng(1)
    for _ in range(150):
        match, top = int(rng.choice([1, 2, 3, 5, 9, 50])), int(rng.choice([1, 2, 3, 30]))
        parts = [rng.integers(1, top + 1, rng.integers(0, 80)).astype(np.uint8).tobytes() for _ in range(3)]
        data = np.frombuffer(b"\0".join([*parts, parts[0][5:]]) + b"\0", np.uint8)
        at, new = suffixes.repeats(data, match, memory=int(rng.choice([10, 1 << 20])))
        raw = data.tobytes() + b"\0" * match
        keys = [raw[i : i + match] for i in at]
        assert sorted(at.tolist()) == list(range(len(data))) and keys == sorted(keys, reverse=True)
        for a, b, n in zip(keys[:-1], keys[1:], new[1:], strict=True):
            assert 0 in a or 0 in b or (a != b) == n


def removed(docs, match=50):
    """(id, bytes, removed, spans, hash) by looking up every window."""
    first, out = {}, []
    for i, text, _ in docs:
        for k in range(len(b := (text or "").encode()) - match + 1):
            first[b[k : k + match]] = min(i, first.get(b[k : k + match], i))
    for i, text, _ in docs:
        b = (text or "").encode()
        hit = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - match + 1):
            if first[b[k : k + match]] < i:
                hit[k : k + match] = True
        cut = hit[: len(b)]
        kept = bytes(np.frombuffer(b, np.uint8)[~cut])
        out.append((i, len(b), int(cut.sum()), int((cut & ~np.r_[False, cut[:-1]]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats(spark, docs):
    got = queries.QUERIES["op5_suffix_dedup"](spark, SMALL).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == removed(docs)
    assert sum(r["n_removed"] for r in got) > 0


def test_repeats_of_many_copies(spark, tmp_path):
    rng = np.random.default_rng(3)
    passage = "".join(rng.choice(list("abcdefgh "), 120))
    made = [(i, ("".join(rng.choice(list("abcd "), rng.integers(0, 90))) + passage) * (1 + i % 2) if i % 3 else passage[: i % 120], "") for i in range(300)]
    spark.createDataFrame(made, "doc_id bigint, text string, source string").repartition(5).write.parquet(str(tmp_path / "d"))
    got = suffix_dedup.with_repeats(spark.read.parquet(str(tmp_path / "d"))).orderBy("doc_id").collect()
    want = removed(made)
    assert [(r["doc_id"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"])) for r in got] == [(w[0], w[2], w[3]) for w in want]


@pytest.mark.parametrize("size", [300, 5000])
def test_repeats_in_small_packs(docs, monkeypatch, size):
    """The four steps in this process, with many packs, slices, parts and shards."""
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", size)
    monkeypatch.setattr(suffix_dedup, "PACK_BYTES", 3 * size)
    some = docs[:90]
    batches = [pa.RecordBatch.from_arrays([pa.array([d[0] for d in part]), pa.array([d[1] for d in part])], ["place", "text"]) for part in (some[:40], some[40:])]

    def table(rows):
        return sorted((r for b in rows for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[0])

    def batch(rows, names):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    packed = table(suffix_dedup.anchor_rows(7)(batches))
    runs = {}
    for place, run in table(suffix_dedup.candidate_rows([batch(packed[:20], list("abcdefg")), batch(packed[20:], list("abcdefg"))])):
        runs.setdefault(place, []).append(run)
    again = [d for d in some if d[0] in runs]
    sent = table(suffix_dedup.snippet_rows(5)([pa.RecordBatch.from_arrays([pa.array([d[0] for d in again]), pa.array([d[0] for d in again]), pa.array([d[1] for d in again]), pa.array([runs[d[0]] for d in again], pa.list_(pa.int32()))], list("abcd"))]))
    marks = {}
    for place, span in table(suffix_dedup.mark_rows([batch(sent, list("abcde"))])):
        marks.setdefault(place, []).append(span)
    got = []
    for i, text, _ in some:
        a, b = suffix_dedup.union_spans(np.array(marks.get(i, []), np.int64))
        got.append((i, len(text.encode()), int((b - a).sum()), len(a), hashlib.sha256(suffix_dedup._kept(text.encode(), a, b)).hexdigest()))
    assert got == removed(some) and marks


# 6


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(ids, fps):
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((root(ids[a]), root(ids[b])))
                label[y] = x
    return {i: root(i) for i in ids}


def test_simhash(spark, docs):
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_simhash"](spark, SMALL).collect()}
    fps = [fingerprint(t) for _, t, _ in docs]
    assert [int(got[d[0]]["fingerprint"], 16) for d in docs] == fps
    assert {i: r["component_id"] for i, r in got.items()} == brute_components([d[0] for d in docs], fps)


def test_golay_code_is_perfect():
    code = simhash.Golay()
    words = np.arange(1 << 23)
    error = code.error[code.low[words & 4095] ^ code.high[words >> 12]]
    assert np.bitwise_count(error.astype(np.uint64)).max() == 3
    assert np.bincount(code.index(words)).tolist() == [2048] * 4096


@pytest.mark.parametrize(("small", "block"), [(16, 1024), (2, 8), (4, 5)])
def test_links_of_clusters(spark, monkeypatch, small, block):
    """Rings and chains of near fingerprints, some with more members in a key than a block."""
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(small)
    made = set()
    for _ in range(6):
        f = int(rng.integers(0, 1 << 63)) << 1 | int(rng.integers(0, 2))
        for _ in range(30):
            made.add(f)
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                f ^= 1 << int(b)
    fps = sorted(made)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp bigint").repartition(2)
    # in this process, so that the smaller limits hold
    batch = pa.RecordBatch.from_arrays([pa.array(signed)], ["fp"])
    rows = [r for b in simhash.key_rows([batch]) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    rows.sort()
    parts = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[k : k + 50]]), pa.array([r[1] for r in rows[k : k + 50]])], ["key", "fp"]) for k in range(0, len(rows), 50)]
    out = [r for b in simhash.link_rows(parts) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    edges = {(u, v) for u, v, _, _ in out if v is not None}
    blocks = {}
    for u, v, key, block_no in out:
        if v is None:
            blocks.setdefault(key, []).append((block_no, u))
    pairs = sorted({(key, min(b, c), max(b, c), b, u) for key, ms in blocks.items() for b, u in ms for c in {m[0] for m in ms} if c != b})
    if pairs:
        cols = [pa.array([p[k] for p in pairs], pa.int64()) for k in range(5)]
        for b in simhash.cross_rows([pa.RecordBatch.from_arrays(cols, ["key", "lo", "hi", "side", "fp"])]):
            edges |= {(r[0], r[1]) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    label = {f: f for f in signed}

    def root(f):
        while label[f] != f:
            f = label[f]
        return f

    for u, v in edges:
        a, b = sorted((root(u), root(v)))
        label[b] = a
    want = brute_components(signed, fps)
    assert {f: root(f) for f in signed} == want
    if block == 1024:
        found = {r["node"]: r["root"] for r in simhash.components(*simhash.links(frame)).collect()}
        assert {f: found.get(f, f) for f in signed} == want


# 8


def test_mix(spark, duck, docs):
    from ..test_queries import same

    same(queries.QUERIES["op8_mixing"](spark, SMALL).toPandas(), duck.execute(queries.ORACLE_SQL["op8_mixing"]).df())


def test_targets():
    sizes, weights = [10, 1000, 5, 300], [1, 2, 3, 1]
    got = mixing.targets(sizes, weights)
    assert got[0] == 30 and got[2] == 15 and sum(got) == pytest.approx(1315) and got[1] == pytest.approx(2 * got[3] if got[3] < 900 else got[1])
    assert mixing.targets([], []) == [] and mixing.targets([0, 7], [1, 2]) == [0.0, 7.0]


# 9


def png():
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


OBJECTS = {
    "png": png(),
    "wav": media.store_wav(b"\1\2\3"),
    "gif": b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\2\2\x4c\1\0;",
    "bmp": b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0",
    "gzip": __import__("gzip").compress(b"some content", mtime=0),
    "jpeg": b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"JF" + b"\xff\xda" + struct.pack(">H", 3) + b"x" + b"ab\xff\0cd" + b"\xff\xd9",
    "pdf": b"%PDF-1.4\nbody\nstartxref\n9\n%%EOF",
    "pgm": b"P5\n2 2\n255\n\1\2\3\4",
}


@pytest.mark.parametrize("kind", OBJECTS)
def test_objects_are_confirmed_and_carved(kind):
    value = OBJECTS[kind]
    top = next(f for f in media.sniff(value) if f.offset == 0)
    assert (top.kind, top.length) == (kind, len(value))
    inside = [f for f in media.sniff(b"some text " + value + b" and more") if f.kind == kind]
    assert [(f.offset, f.length) for f in inside] == [(10, len(value))]
    assert not [f for f in media.sniff(value[:-1]) if f.kind == kind and f.offset == 0 and kind != "pdf"]


def test_declared_types_are_corrected(spark):
    rows = [(k, k, v) for k, v in OBJECTS.items()] + [("lie", "jpeg", OBJECTS["png"]), ("text", "png", b"GIF89a but no more"), ("none", None, None)]
    got = {r["name"]: r for r in media.with_media(spark.createDataFrame(rows, "name string, said string, content binary"), "content", "said").collect()}
    assert all(got[k]["media_type"] == k and not got[k]["corrected"] for k in OBJECTS)
    assert got["lie"]["media_type"] == "png" and got["lie"]["corrected"]
    assert got["text"]["media_type"] == "unknown" and got["text"]["corrected"] and not got["none"]["corrected"]


def test_stored_media(spark, docs):
    got = {r["doc_id"]: r for r in queries.QUERIES["op9_media"](spark, SMALL).collect()}
    for i, text, _ in docs:
        raw = text.encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        stored = media.store_wav(payload)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(payload), len(stored))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:]) and r["media_sha256"] == hashlib.sha256(stored).hexdigest()


# 2


def test_curve_of_classes_without_overlap():
    from knnloom.llm.toxicity import fit_curve

    rng = np.random.default_rng(0)
    for shift in (0.3, 3.0, 300.0):
        y = (np.arange(4000) % 10 == 0).astype(float)
        x = rng.normal(0, 1, (4000, 4)) + shift * y[:, None]
        w = fit_curve(x, y)
        p = 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -35, 35)))
        assert p[y == 1].mean() > p[y == 0].mean() + 0.02 and p.mean() == pytest.approx(0.1, abs=0.01)
