"""Each demo query against DuckDB on the same tables."""

import math
import os

import pytest

from gridspark import demo

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for n in os.listdir(SF):
        con.execute(f"CREATE VIEW {n.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{n}'")
    return con


def plain(rows):
    value = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(value(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", demo.queries())
def test_against_tables(spark, duck, name):
    df = demo.queries()[name](spark, SF)
    names = sorted(df.columns)
    want = duck.execute(f"SELECT {', '.join(names)} FROM ({demo.oracle_sql()[name]})")
    assert plain(df.select(*names).collect()) == plain(want.fetchall())


def test_other_rows_under_the_same_path_make_another_store(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    seen = []
    for n in (20, 10):
        rows.limit(n).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
        spark.catalog.clearCache()
        seen.append(demo.queries()["zarr_scan_array_alias"](spark, str(tmp_path)).collect()[0][0])
    assert seen == [20, 10]
    assert demo.store(spark, str(tmp_path), "embeddings").startswith(spark.conf.get("spark.checkpoint.dir"))
