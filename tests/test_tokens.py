"""The token scan: any white space, any split, and errors that name the byte."""

import numpy as np
import pytest

from knnloom.operators import generate_uniform
from knnloom.sources import read_points, tokens, write_points

GAPS = [" ", "\n", "\t", "\r\n", "  \n\n ", "\v", "\f"]


def text(rng, n):
    points = [(int(rng.integers(0, 10**9)), float(np.round(rng.normal(), int(rng.integers(0, 12)))), float(rng.normal() * 10.0 ** rng.integers(-20, 20))) for _ in range(n)]
    gap = lambda: GAPS[rng.integers(len(GAPS))]
    return points, gap().join([""] * int(rng.integers(1, 3))) + "".join(f"{v!r}{gap()}" for p in points for v in p)


@pytest.mark.parametrize("block", [1, 3, 17, 1 << 20])
def test_all_splits_of_random_texts(tmp_path, monkeypatch, block):
    monkeypatch.setattr(tokens, "BLOCK_BYTES", block)
    rng = np.random.default_rng(block)
    for n in (0, 1, 2, 9):
        points, data = text(rng, n)
        data = data.rstrip() if n % 2 else data
        path = str(tmp_path / f"{n}.txt")
        (tmp_path / f"{n}.txt").write_bytes(data.encode())
        for size in (1, 2, 5, 11, 1000):
            got, before = [], 0
            for a in range(0, len(data), size):
                for b in tokens.read(path, a, min(a + size, len(data)), before, 0):
                    got += zip(*(c.to_pylist() for c in b.columns), strict=True)
                before += tokens.count(path, a, min(a + size, len(data)))
            assert before == 3 * n and got == [(*p, i) for i, p in enumerate(points)]


@pytest.mark.parametrize("split", [7, 64, 1 << 20])
def test_points_over_line_ends_and_splits(spark, tmp_path, monkeypatch, split):
    monkeypatch.setattr(tokens, "SPLIT_BYTES", split)
    points, data = text(np.random.default_rng(4), 40)
    (tmp_path / "p.txt").write_text(data, newline="")
    assert sorted(map(tuple, read_points(spark, str(tmp_path / "p.txt")).collect())) == sorted(points)
    placed = tokens.read_tokens(spark, f"file://{tmp_path}/p.txt", place=True).orderBy("place").collect()
    assert [tuple(r) for r in placed] == [(*p, i) for i, p in enumerate(points)]


def test_a_folder_of_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "SPLIT_BYTES", 50)
    made = generate_uniform(spark, 30).repartition(3)
    write_points(made, str(tmp_path / "p.txt"))
    got = tokens.read_tokens(spark, str(tmp_path / "p.txt"), place=True).collect()
    assert sorted(r["id"] for r in got) == list(range(1, 31)) and sorted(r["place"] for r in got) == list(range(30))


@pytest.mark.parametrize(("data", "said"), [("1 2 3\n4 x5 6", "'x5' at byte 8"), ("1 2 3\n4 5", "ends within the point at byte 6"), ("1.5 2 3", "'1.5' at byte 0"), ("99999999999999999999 1 1", "at byte 0"), ("é 1 1", "'é' at byte 0")])
def test_errors_name_the_byte(spark, tmp_path, data, said):
    (tmp_path / "p.txt").write_text(data)
    with pytest.raises(Exception, match=said):
        read_points(spark, str(tmp_path / "p.txt")).collect()


def test_missing_and_empty_files(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_points(spark, str(tmp_path / "none.txt"))
    (tmp_path / "p.txt").write_text("")
    assert read_points(spark, str(tmp_path / "p.txt")).count() == 0


def test_neighbours_in_file_order(spark, tmp_path):
    from knnloom.operators import aknn_join
    from knnloom.sources import write_neighbours

    order = [5, 2, 9, 1, 7]
    (tmp_path / "q.txt").write_text(" ".join(f"{i} 0.{i} 0.5" for i in order))
    places = tokens.read_tokens(spark, str(tmp_path / "q.txt"), place=True)
    write_neighbours(aknn_join(places, places, 2), str(tmp_path / "out"), places=places)
    lines = [line for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().splitlines()]
    assert [int(line.split("\t")[0]) for line in lines] == order
