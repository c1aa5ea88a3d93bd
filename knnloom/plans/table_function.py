"""The join as a table function of SQL: ``SELECT * FROM aknn(10)``.

``create_aknn`` cuts the candidates into the sweep's tiles and registers, for a
name of one's choice, two table functions that sweep the rows of a tile,

    SELECT * FROM aknn_first(TABLE(aknn_rows) PARTITION BY (tile, part))
    SELECT * FROM aknn_second(TABLE(...) PARTITION BY (tile, part))

and a function over them, ``aknn(k)`` for any k up to the one it was made for.
Round one is run once, at creation, and stays as a table; a call reads it, sweeps
the tiles in reach and merges the states.  So the function answers for both sets
as they were when it was made.

A tile's crowd of points is dealt to several parts, which round two keeps: a tile's
candidates go to each part that asks for them, and tiles nobody asks for go nowhere.
Views and functions belong to the session; tables in the shared folder go as ``kept``
says.  Without candidates the function gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import finite_points
from ..operators.states import STATE
from ..sources.scratch import kept
from .sweep import FIRST, Ends, at_home, cut, first_round, parted, second_round

ROWS = "tile int, part int, input_id bigint, neighbor_id bigint, v double, u double, bound double"
RESULT = "input_id BIGINT, rnk BIGINT, neighbor_id BIGINT, dist_sq DOUBLE"


def sweeper(sweep: Callable[..., pa.Table], schema: str):
    """A table function over ROWS by (tile, part) whose groups are swept; results carry the part."""

    class Sweeper:
        def __init__(self) -> None:
            self.held: list[pa.RecordBatch] = []

        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            self.held.append(batch)
            yield from ()

        def terminate(self) -> Iterator[pa.Table]:
            if not self.held:
                return
            rows = pa.Table.from_batches(self.held)
            asked = pa.compute.is_valid(rows["input_id"])
            left, right = rows.filter(asked), rows.filter(pa.compute.invert(asked))
            if not left.num_rows or not right.num_rows:
                return
            right = right.select(["neighbor_id", "v", "u"]).rename_columns(["neighbor_id", "tv", "tu"])
            out = sweep((rows["tile"][0],), left, right)
            yield out.append_column("part", pa.array([rows["part"][0].as_py()] * out.num_rows, pa.int32()))

    return F.arrow_udtf(Sweeper, returnType=f"{schema}, part int")


def sides(points: DataFrame, candidates: DataFrame) -> DataFrame:
    """Points (tile, part, input_id, v, u, bound) and candidates (tile, part, neighbor_id, tv, tu) as rows of one table."""
    none = F.lit(None)
    left = points.select("tile", "part", "input_id", none.cast("bigint").alias("neighbor_id"), "v", "u", "bound")
    right = candidates.select("tile", "part", none.cast("bigint").alias("input_id"), "neighbor_id", F.col("tv").alias("v"), F.col("tu").alias("u"), none.cast("double").alias("bound"))
    return left.unionByName(right)


def create_aknn(spark: SparkSession, queries: DataFrame, candidates: DataFrame, most: int, name: str = "aknn") -> None:
    """Registers ``name(k)``, k up to ``most``: (input_id, rnk, neighbor_id, dist_sq) of points (id, x, y)."""
    if most < 1 or not re.fullmatch(r"[A-Za-z]\w*", name):
        raise ValueError("most must be at least 1, and name a plain identifier")
    q, t = finite_points(queries), finite_points(candidates)
    n = t.count()
    one, inside = spark.createDataFrame([], f"{FIRST}, part int"), spark.createDataFrame([], "tile int, neighbor_id bigint, tv double, tu double")
    if n:
        tiles = cut(t, most, n)
        spark.udtf.register(f"{name}_first", sweeper(first_round(Ends(tiles.boxes, most), most), FIRST))
        inside = kept(tiles.rows.drop("stripe"))
        points, training = parted(at_home(q, tiles), inside)
        sides(points.withColumn("bound", F.lit(None).cast("double")), training).createOrReplaceTempView(f"{name}_rows")
        one = kept(spark.sql(f"SELECT * FROM {name}_first(TABLE({name}_rows) PARTITION BY (tile, part))"))
    spark.udtf.register(f"{name}_second", sweeper(second_round(most), f"{STATE}, seen bigint"))
    one.createOrReplaceTempView(f"{name}_swept")
    inside.createOrReplaceTempView(f"{name}_tiles")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY VIEW {name}_asked AS WITH r AS (SELECT tile, part, input_id, v, u, bound FROM {name}_swept LATERAL VIEW explode(others) o AS tile)
        SELECT tile, part, input_id, CAST(NULL AS BIGINT) AS neighbor_id, v, u, bound FROM r
        UNION ALL SELECT t.tile, p.part, NULL, t.neighbor_id, t.tv, t.tu, NULL FROM {name}_tiles t JOIN (SELECT DISTINCT tile, part FROM r) p ON p.tile = t.tile""")
    # all states of a point are merged, k of each tile at most; most points need one tile alone
    spark.sql(f"""CREATE OR REPLACE TEMPORARY VIEW {name}_near AS WITH s AS (
            SELECT input_id, ids, far FROM {name}_swept WHERE size(others) > 0
            UNION ALL SELECT input_id, ids, far FROM {name}_second(TABLE({name}_asked) PARTITION BY (tile, part))),
        m AS (SELECT input_id, slice(array_sort(flatten(collect_list(arrays_zip(far, ids)))), 1, {most}) AS near FROM s GROUP BY input_id
            UNION ALL SELECT input_id, arrays_zip(far, ids) FROM {name}_swept WHERE size(others) = 0)
        SELECT input_id, CAST(place + 1 AS BIGINT) AS rnk, one.ids AS neighbor_id, one.far AS dist_sq FROM m LATERAL VIEW posexplode(near) p AS place, one""")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(k INT) RETURNS TABLE ({RESULT}) RETURN SELECT * FROM {name}_near WHERE assert_true({name}.k BETWEEN 1 AND {most}) IS NULL AND rnk <= {name}.k")
