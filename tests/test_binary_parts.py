"""The distributed binary sink: counted parts, their list, one file of them."""

import json
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from knnloom.operators import generate_uniform
from knnloom.sources import points as points_module
from knnloom.sources import read_points, write_points
from knnloom.sources.points import LIST, BinaryPointsReader, BinaryPointsWriter, Written


def rows(df):
    return sorted(map(tuple, df.collect()))


def batch(ids):
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([float(i) for i in ids]), pa.array([-float(i) for i in ids])], ["id", "x", "y"])


@pytest.mark.parametrize("n", [0, 1, 500])
def test_round_trips(spark, tmp_path, n):
    made = generate_uniform(spark, n).repartition(3)
    for suffix in ("bins", "bin"):
        path = str(tmp_path / f"p{n}.{suffix}")
        write_points(made, path)
        assert rows(read_points(spark, path)) == rows(made)
    data = (tmp_path / f"p{n}.bin").read_bytes()
    assert struct.unpack("<Q", data[:8])[0] == n and len(data) == 8 + 24 * n
    assert sum(k for _, k in json.loads((tmp_path / f"p{n}.bins" / LIST).read_text())) == n
    assert [p.name for p in tmp_path.iterdir() if p.name.endswith(".bins")] == [f"p{n}.bins"]  # no parts are left over
    with pytest.raises(ValueError):
        write_points(made, str(tmp_path / f"p{n}.bins"))


@pytest.mark.parametrize("most", [1, 7, 10, 1000])
def test_parts_hold_so_many_records(tmp_path, monkeypatch, most):
    monkeypatch.setattr(points_module, "PART_RECORDS", most)
    writer = BinaryPointsWriter(str(tmp_path / "p.bins"))
    got = writer.write(iter([batch(range(5)), batch([]), batch(range(5, 23)), batch([23])]))
    writer.commit([got, None, writer.write(iter([]))])
    assert [n for _, n in got.parts] == [most] * (24 // most) + [24 % most] * bool(24 % most)
    reader = BinaryPointsReader(str(tmp_path / "p.bins"))
    read = [i for s in reader.partitions() for b in reader.read(s) for i in b.column(0).to_pylist()]
    assert read == list(range(24))


def test_failed_attempts_dont_count(spark, tmp_path):
    path = str(tmp_path / "p.bins")
    writer = BinaryPointsWriter(path)
    kept, lost = writer.write(iter([batch([1, 2])])), writer.write(iter([batch([1, 2])]))  # a second attempt of the task
    with pytest.raises(ValueError, match="didn't end"):
        BinaryPointsReader(path).partitions()
    writer.commit([kept])
    assert rows(read_points(spark, path)) == [(1, 1.0, -1.0), (2, 2.0, -2.0)]
    writer.abort([lost, None])
    assert sorted(p.name for p in (tmp_path / "p.bins").iterdir()) == sorted([LIST, kept.parts[0][0]])


def test_broken_parts_are_errors(spark, tmp_path):
    path = tmp_path / "p.bins"
    writer = BinaryPointsWriter(str(path))
    got = writer.write(iter([batch([1, 2, 3])]))
    writer.commit([Written([(got.parts[0][0], 4)])])
    reader = BinaryPointsReader(str(path))
    with pytest.raises(ValueError, match="fewer records"):
        list(reader.read(reader.partitions()[0]))
    part = path / got.parts[0][0]
    part.write_bytes(part.read_bytes()[:-1])
    with pytest.raises(ValueError, match="header counts"):
        list(reader.read(reader.partitions()[0]))


def test_a_failing_job_leaves_no_list(spark, tmp_path):
    bad = generate_uniform(spark, 20).withColumn("x", F.when(F.col("id") == 13, F.lit(None)).otherwise(F.col("x")))
    with pytest.raises(Exception, match="without x"):
        write_points(bad, str(tmp_path / "p.bins"))
    with pytest.raises(Exception):  # noqa: B017
        read_points(spark, str(tmp_path / "p.bins")).collect()


def test_no_record_passes_the_driver(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    made = generate_uniform(spark, 100)
    for name in ("toLocalIterator", "toPandas", "toArrow"):
        monkeypatch.setattr(type(made), name, lambda *a, **b: pytest.fail("records on the driver"))
    assert isinstance(made, DataFrame)
    write_points(made, str(tmp_path / "p.bin"))
    assert read_points(spark, str(tmp_path / "p.bin")).count() == 100
