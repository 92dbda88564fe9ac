"""Grids written from rows: places from files, and chunks written where their rows are read."""

import os

import pytest
from pyspark.sql import functions as F

import gridspark
from gridspark import testing as W
from gridspark.testing import Spec


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """5,003 rows in files that end within chunks, one of them shorter than a chunk, read as it stands."""
    path = str(tmp_path_factory.mktemp("grids") / "t.parquet")
    rows = spark.range(5003).selectExpr("id", "cast(id % 7 as int) as small", "id / 3 as part", "timestamp_micros(id * 1000003) as at", "transform(sequence(0, cast(if(id % 1000 = 999, 2, 4) as int)), d -> cast(id * 10 + d as float)) as v")
    for low, high in ((0, 1700), (1700, 1730), (1730, 5003)):
        rows.where(f"id >= {low} and id < {high}").coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def moved(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


ARRAYS = [Spec("id", "id", "i8"), Spec("small", "small", "i4", fill=-1), Spec("part", "part", "f8", codecs=[{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "gzip"}]), Spec("at", "at", "i8")]


def test_places_are_those_of_the_rows_in_the_files(spark, files, tmp_path):
    placed = W.numbered(files, str(tmp_path))
    assert sorted(r[0] for r in placed.select("i").collect()) == list(range(5003))
    assert os.listdir(tmp_path) == []  # nothing is written for it
    again = {r["id"]: r["i"] for r in W.numbered(files, str(tmp_path)).collect()}
    assert {r["id"]: r["i"] for r in placed.collect()} == again
    ranked = W.numbered(files.select("id", "small"), str(tmp_path), "id")
    assert ranked.where("i != id").count() == 0 and ranked.count() == 5003


def test_chunks_are_written_where_their_rows_are_read(spark, files, tmp_path):
    placed = W.numbered(files, str(tmp_path)).persist()
    want = sorted((r["i"], r["id"], r["small"], r["part"], int(r["us"])) for r in placed.withColumn("us", F.unix_micros("at")).collect())
    placed.unpersist()
    sizes = {}
    for ordered in (False, True):
        root = str(tmp_path / f"{ordered}.zarr")
        W.write_group(root)
        before = moved(spark)
        W.write_grid(W.numbered(files, str(tmp_path)), root, ["row"], ["i"], (5003,), (100,), ARRAYS, ordered=ordered)
        sizes[ordered] = moved(spark) - before
        got = sorted(map(tuple, gridspark.read_zarr(spark, root).select("row", "id", "small", "part", "at").collect()))
        assert got == want
    assert sizes[True] < sizes[False] / 4  # the rows of chunks cut by the ends of files, and counts


@pytest.mark.parametrize("ordered", [False, True])
def test_grids_of_two_dimensions_with_cells_missing(spark, files, tmp_path, ordered):
    placed = W.numbered(files, str(tmp_path))
    want = sorted(map(tuple, placed.select("i", F.posexplode("v")).collect()))
    root = str(tmp_path / "two.zarr")
    W.write_group(root)
    cells = placed.select("i", F.posexplode("v").alias("d", "x"))
    W.write_grid(cells, root, ["row", "d"], ["i", "d"], (5003, 5), (70, 2), [Spec("x", "x", "f4", fill=-1.0)], ordered=ordered)
    got = gridspark.read_zarr(spark, root)
    assert got.count() == 5003 * 5
    assert sorted(map(tuple, got.where("x is not null").select("row", "d", "x").collect())) == want


def test_cells_in_any_order_give_the_same_grid(spark, tmp_path):
    cells = spark.range(900).repartition(5).selectExpr("id div 30 as a", "id % 30 as b", "id as x")
    root = str(tmp_path / "any.zarr")
    W.write_group(root)
    W.write_grid(cells, root, ["a", "b"], ["a", "b"], (30, 30), (7, 11), [Spec("x", "x", "i8")], ordered=True)
    assert sorted(map(tuple, gridspark.read_zarr(spark, root).collect())) == [(n // 30, n % 30, n) for n in range(900)]
