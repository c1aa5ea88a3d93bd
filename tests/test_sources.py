"""Files, tools and the stream."""

import re
import struct

import pytest

from knnloom.operators import aknn_join, generate_uniform, multiply, target_count
from knnloom.plans.tiles import stripe_stats
from knnloom.sources import read_points, write_metrics, write_neighbours, write_points, write_stripes
from knnloom.streaming import stream_aknn


def rows(df):
    return sorted(tuple(r) for r in df.select("id", "x", "y").collect())


@pytest.mark.parametrize("suffix", ["txt", "bin", "parquet"])
def test_round_trip(spark, tmp_path, suffix):
    p = generate_uniform(spark, 50, seed=3).selectExpr("id", "round(x, 6) as x", "round(y, 6) as y").persist()
    path = str(tmp_path / f"points.{suffix}")
    write_points(p, path)
    assert rows(read_points(spark, path)) == rows(p)


def test_text_is_checked(spark, tmp_path):
    (tmp_path / "good.txt").write_text("1 0.5 0.25\n\n  2\t1e-3   -4 \n")
    assert rows(read_points(spark, str(tmp_path / "good.txt"))) == [(1, 0.5, 0.25), (2, 0.001, -4.0)]
    (tmp_path / "bad.txt").write_text("1 0.5 0.25\n2 zero 1\n")
    with pytest.raises(Exception, match="malformed"):
        read_points(spark, str(tmp_path / "bad.txt")).collect()
    with pytest.raises(Exception, match="(?i)path"):
        read_points(spark, str(tmp_path / "missing.txt")).collect()


def test_binary_is_checked(spark, tmp_path):
    path = tmp_path / "short.bin"
    path.write_bytes(struct.pack("<QQdd", 2, 1, 0.0, 0.0))
    with pytest.raises(Exception, match="header"):
        read_points(spark, str(path)).collect()


@pytest.mark.parametrize(("n", "sizes"), [(10, {-2: 5, -1: 5, 1: 10, 2: 20, 4: 40}), (11, {-2: 6, -1: 5, 1: 11, 2: 20, 4: 44})])
def test_multiplier_sizes(spark, n, sizes):
    p = generate_uniform(spark, n)
    for factor, size in sizes.items():
        got = multiply(p, factor)
        assert got.count() == size == target_count(n, factor)
        if factor != 1:
            assert sorted(r["id"] for r in got.collect()) == list(range(1, size + 1))
    with pytest.raises(ValueError):
        multiply(p, 3)


def test_places_of_many_ranges(spark):
    from knnloom.operators.datasets import with_place

    p = generate_uniform(spark, 300_000).selectExpr("id * 7 as id", "x", "y").repartition(5)
    wrong = with_place(p).where("place != id / 7 - 1").count()
    by_y = with_place(p, "y", "id").select("place").distinct().count()
    assert wrong == 0 and by_y == 300_000


def test_generator_follows_its_seed(spark):
    assert rows(generate_uniform(spark, 20, 4)) == rows(generate_uniform(spark, 20, 4)) != rows(generate_uniform(spark, 20, 5))


def test_result_files(spark, tmp_path):
    p = generate_uniform(spark, 20)
    write_neighbours(aknn_join(p, p, 3, "grid"), str(tmp_path / "n"))
    assert spark.read.text(str(tmp_path / "n")).count() == 20
    write_metrics(spark.createDataFrame([("brute", 1234.5)], "strategy string, seconds double"), str(tmp_path / "m"), localised=True)
    assert spark.read.text(str(tmp_path / "m")).collect()[1][0] == "brute;1.234,500000"
    write_stripes(stripe_stats(p, p, 3), str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s"), sep=";", header=True).columns == ["StripeId", "MinY", "MaxY", "InputPoints", "TrainingPoints"]


def test_stripe_stats_cover_all_points(spark):
    p, q = generate_uniform(spark, 300, 7), generate_uniform(spark, 100, 9)
    got = stripe_stats(q, p, 3).collect()
    assert len(got) == 10 and sum(r["n_training"] for r in got) == 300 and sum(r["n_input"] for r in got) == 100
    assert {r["n_training"] for r in got} == {30}


def test_stream(spark, tmp_path):
    p = generate_uniform(spark, 40).persist()
    p.where("id <= 5").write.parquet(str(tmp_path / "in"))
    seen = []
    query = stream_aknn(spark.readStream.schema("id bigint, x double, y double").parquet(str(tmp_path / "in")), p, 2, lambda df, n: seen.extend(df.collect()), str(tmp_path / "check"))
    query.awaitTermination(60)
    assert sorted((r["input_id"], r["rnk"]) for r in seen) == [(i, r) for i in range(1, 6) for r in (1, 2)]


def test_command_line(spark, tmp_path, capsys):
    from knnloom.__main__ import main

    write_points(generate_uniform(spark, 60), str(tmp_path / "p.bin"))
    main(["3", str(tmp_path / "p.bin"), str(tmp_path / "p.bin"), "--mask", "1001", "--save", str(tmp_path / "out"), "--metrics", str(tmp_path / "metrics")])
    assert "loaded in" in capsys.readouterr().out
    names = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert [re.sub(r"_\d{14}_\d+$", "", n) for n in names] == ["brute", "sweep_x"]
    assert all(spark.read.text(str(tmp_path / "out" / n)).count() == 60 for n in names)
    head = spark.read.csv(str(tmp_path / "metrics"), sep=";", header=True).columns
    assert len(head) == 16 and head[0] == "Algorithm" and head[-1] == "First 5 different point ids"


def test_command_line_pads_and_checks(spark, tmp_path, capsys):
    from knnloom.__main__ import main

    (tmp_path / "q.txt").write_text("1 0.5 0.25\n2 NaN 0.5\n")
    (tmp_path / "t.txt").write_text("1 0.5 0.5\n2 NaN 1\n")
    main(["2", str(tmp_path / "q.txt"), str(tmp_path / "t.txt"), "--mask", "1", "--save", str(tmp_path / "out")])
    (name,) = (tmp_path / "out").iterdir()
    assert [r[0] for r in spark.read.text(str(name)).collect()] == ["1\t(NULL 1.79769e+308)\t(1 0.0625)"]
    with pytest.raises(SystemExit):
        main(["0", str(tmp_path / "q.txt"), str(tmp_path / "t.txt")])


def test_tools_on_the_command_line(spark, tmp_path, capsys):
    from knnloom.__main__ import main

    main(["generate", "11", str(tmp_path / "p.bin"), "--seed", "4"])
    assert rows(read_points(spark, str(tmp_path / "p.bin"))) == rows(generate_uniform(spark, 11, 4))
    main(["multiply", str(tmp_path / "p.bin"), str(tmp_path / "thin.txt"), "-2"])
    main(["multiply", str(tmp_path / "p.bin"), str(tmp_path / "four.parquet"), "4"])
    main(["multiply", str(tmp_path / "p.bin"), str(tmp_path / "same.txt"), "1"])
    lines = sorted(r[0] for r in spark.read.text(str(tmp_path / "thin.txt")).collect())
    assert len(lines) == 6 and all(re.fullmatch(r"\d\t0\.\d{10}\t0\.\d{10}", x) for x in lines)
    assert read_points(spark, str(tmp_path / "four.parquet")).count() == 44
    assert all(re.fullmatch(r"\d+\t0\.\d{8}\t0\.\d{8}", r[0]) for r in spark.read.text(str(tmp_path / "same.txt")).collect())
    assert "6 points written" in capsys.readouterr().out


def test_generator_does_not_depend_on_partitions(spark):
    one = rows(generate_uniform(spark, 100, 4))
    assert one == rows(generate_uniform(spark, 100, 4).repartition(7)) and all(0 <= x < 1 and 0 <= y < 1 for _, x, y in one)
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "9")
    assert rows(generate_uniform(spark, 100, 4)) == one
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_large_ids_of_binary_files(spark, tmp_path):
    path = tmp_path / "large.bin"
    path.write_bytes(struct.pack("<QQdd", 1, 1 << 63, 0.0, 0.0))
    with pytest.raises(Exception, match="id"):
        read_points(spark, str(path)).collect()
