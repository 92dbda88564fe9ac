"""Queries over stores that are written from plain tables, each beside the SQL that gives the same
rows from the tables themselves. Used by tests, the benchmark and the driver's entry module.

The stores are fixtures, written by Spark tasks, a chunk at a time, and read back through the engine
as any store is."""

from __future__ import annotations

import functools
import hashlib
import os
import shutil
import tempfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import testing as W
from .errors import ZarrError
from .plans.sqltext import sql
from .shipping import ship
from .testing import Spec

_BYTES = {"name": "bytes", "configuration": {"endian": "little"}}
_ZSTD = [_BYTES, {"name": "zstd", "configuration": {"level": 1}}]
_BLOSC = [_BYTES, {"name": "blosc", "configuration": {"shuffle": "shuffle"}}]
_SHARDS = [{"name": "sharding_indexed", "configuration": {"chunk_shape": [2, 3, 4], "codecs": _ZSTD, "index_codecs": [_BYTES, {"name": "crc32c"}]}}]
_TURNED = [{"name": "transpose", "configuration": {"order": [3, 1, 0, 2]}}, {"name": "bytes", "configuration": {"endian": "big"}}, {"name": "gzip", "configuration": {"level": 1}}, {"name": "crc32c"}]


def _lineitem(root: str, t: DataFrame, base: str) -> None:
    W.write_group(root)
    rows = W.numbered(t, base)
    n = rows.count()
    cells = rows.select("*", F.round(F.col("l_discount") * 100).alias("discount"), F.round(F.col("l_tax") * 100).alias("tax"), F.ascii("l_returnflag").alias("flag"), F.ascii("l_linestatus").alias("status"))
    plain = [("orderkey", "l_orderkey", "i8"), ("partkey", "l_partkey", "i8"), ("suppkey", "l_suppkey", "i8"), ("linenumber", "l_linenumber", "i4"), ("quantity", "l_quantity", "f8"), ("price", "l_extendedprice", "f8"), ("shipdate", "l_shipdate", "i8"), ("returnflag", "flag", "u1"), ("linestatus", "status", "u1")]
    arrays = [Spec(*x, codecs=_ZSTD) for x in plain] + [Spec("discount", "discount", "i2", {"scale_factor": 0.01}, _ZSTD), Spec("tax", "tax", "i2", {"scale_factor": 0.01, "missing_value": 0}, _ZSTD)]
    W.write_grid(cells, root, ["row"], ["i"], (n,), (50_000 if n > 100_000 else 7_000,), arrays, ordered=True)


def _embeddings(root: str, t: DataFrame, base: str) -> None:
    W.write_group(root)
    rows = W.numbered(t, base)
    n, width = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    W.write_grid(rows, root, ["vec"], ["i"], (n,), (300,), [Spec("vec", "vec_id", "i8"), Spec("label", "label", "i4")], ordered=True)
    W.write_grid(rows.select("i", F.posexplode("embedding").alias("d", "x")), root, ["vec", "d"], ["i", "d"], (n, width), (300, 24), [Spec("embedding", "x", "f4", codecs=_BLOSC)], ordered=True)


def _orders(root: str, t: DataFrame, base: str) -> None:
    W.write_v2_group(root)
    rows = W.numbered(t.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"), base, "o_orderkey")
    blosc = {"id": "blosc"}
    arrays = [Spec("orderkey", "o_orderkey", "<i8", compressor={"id": "zlib"}), Spec("custkey", "o_custkey", ">i8", compressor=blosc), Spec("totalprice", "o_totalprice", "<f8", compressor=blosc), Spec("orderdate", "o_orderdate", "<i8", compressor=blosc)]
    W.write_grid(rows, root, ["orderkey"], ["i"], (rows.count(),), (10_000,), arrays, version=2, ordered=True)


def _activity(root: str, t: DataFrame, base: str) -> None:
    """How many events of each kind a user had; the chunks and cells without any hold the fill value."""
    users = W.numbered(t.select("user_id").distinct(), base, "user_id")
    kinds = W.numbered(t.select("event_type").distinct(), base, "event_type").withColumnRenamed("i", "j")
    n, k = users.count(), kinds.count()
    W.write_group(root)
    W.write_grid(users, root, ["user"], ["i"], (n,), (n,), [Spec("user", "user_id", "i8")])
    cells = t.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).join(users, "user_id").join(kinds, "event_type")
    W.write_grid(cells, root, ["user", "kind"], ["i", "j"], (n, k), (max(1, n // 4), 2), [Spec("n", "n", "i4", codecs=_ZSTD, fill=-1)])


def _cube(root: str, t: DataFrame, base: str) -> None:
    """Lines by month, supplier and part as a grid of time, lat and lon, and by line number as level:
    a sharded, a transposed and a nested array, bounds, a scalar and an auxiliary coordinate."""
    W.write_group(root)
    cells = t.select((F.month("l_shipdate") - 1).cast("long").alias("t"), (F.col("l_suppkey") % 6).alias("j"), (F.col("l_partkey") % 8).alias("k"), (F.col("l_linenumber") - 1).cast("long").alias("l"), "l_quantity")
    sums = (F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))
    three = cells.groupBy("t", "j", "k").agg(*sums).withColumn("odd", F.when(F.col("j") == 0, F.lit(float("nan"))).otherwise(F.col("qty")))
    aux = {"coordinates": "area"}
    W.write_grid(three, root, ["time", "lat", "lon"], ["t", "j", "k"], (12, 6, 8), (4, 6, 8), [Spec("qty", "qty", "f8", aux, _SHARDS, -1.0), Spec("n", "n", "i4", None, _ZSTD, 0), Spec("odd", "odd", "f8", None, _BLOSC)])
    W.write_grid(cells.groupBy("t", "l", "j", "k").agg(*sums), root, ["time", "level", "lat", "lon"], ["t", "l", "j", "k"], (12, 7, 6, 8), (5, 7, 4, 8), [Spec("by_level", "qty", "f8", None, _TURNED, -1.0)])
    W.write_grid(cells.groupBy("j", "k").agg(*sums), root, ["lat", "lon"], ["j", "k"], (6, 8), (4, 4), [Spec("deep/inner/share", "n", "i8")])
    W.write_array(root, "time", np.arange(12), ["time"], attrs={"bounds": "time_bnds"})
    W.write_array(root, "lat", 50.0 - 10 * np.arange(6), ["lat"], (4,))
    W.write_array(root, "lon", 2.5 * np.arange(8), ["lon"])
    W.write_array(root, "level", 100 * np.arange(1, 8, dtype="i4"), ["level"])
    W.write_array(root, "time_bnds", np.stack([np.arange(12), np.arange(1, 13)], axis=1), ["time", "nv"])
    W.write_array(root, "crs", np.array(4326, "i4"), [])
    W.write_array(root, "area", np.ones((6, 8)), ["lat", "lon"])


#: store -> its table and its writer
_STORES = {"lineitem": ("lineitem", _lineitem), "embeddings": ("embeddings", _embeddings), "orders": ("orders", _orders), "events": ("events", _activity), "cube": ("lineitem", _cube)}


def store(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The path of a store, written when first asked for: in the shared folder of spark.checkpoint.dir
    where that is a local path, named by the input's files, sizes and times. Without one, only local
    mode can go on, in the temporary folder."""
    table, write = _STORES[name]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    files = sorted(map(tuple, rows.select("_metadata.file_path", "_metadata.file_size", F.col("_metadata.file_modification_time").cast("double")).distinct().collect()))
    shared = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
    if not shared.startswith("/") and not spark.sparkContext.master.startswith("local["):
        raise ZarrError("stores for the demo queries need a spark.checkpoint.dir that all machines see as a local folder")
    base = os.path.join(shared if shared.startswith("/") else tempfile.gettempdir(), "gridspark-demo-" + hashlib.sha256(f"{os.getuid()} {sf_dir} {files} 5".encode()).hexdigest()[:16])
    path = os.path.join(base, f"{name}.zarr")
    if not os.path.exists(path):
        ship(spark)
        os.makedirs(base, exist_ok=True)
        made, work = tempfile.mkdtemp(dir=base), tempfile.mkdtemp(dir=base)
        write(made, rows, work)
        shutil.rmtree(work)
        try:
            os.rename(made, path)
        except OSError:  # another process was first
            shutil.rmtree(made)
    return path


#: The cells of the cube store, for the SQL beside its queries.
_CELLS = "WITH c AS (SELECT month(l_shipdate) - 1 AS t, l_suppkey % 6 AS j, l_partkey % 8 AS k, l_linenumber AS l, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4), s AS (SELECT t, j, k, sum(q) AS q, sum(n) AS n FROM c GROUP BY 1, 2, 3) "
#: name -> (query over stores, in braces by table; the same over the tables, for another SQL engine)
QUERIES: dict[str, tuple[str, str]] = {
    "scan_count": ("SELECT count(*) AS n FROM '{lineitem}'", "SELECT count(*) AS n FROM lineitem"),
    "scan_rows": ("SELECT vec, d, embedding::DOUBLE AS x FROM read_zarr('{embeddings}', dims='vec,d')", "SELECT vec_id AS vec, CAST(d AS BIGINT) AS d, CAST(embedding[d + 1] AS DOUBLE) AS x FROM embeddings, range(0, (SELECT max(len(embedding)) FROM embeddings)) r(d)"),
    "scan_dims_json": ("SELECT count(*) AS n, min(d) AS lo, max(d) AS hi FROM read_zarr('{embeddings}', dims='[\"vec\",\"d\"]')", "SELECT sum(len(embedding))::BIGINT AS n, 0::BIGINT AS lo, max(len(embedding))::BIGINT - 1 AS hi FROM embeddings"),
    "scan_array_path": ("SELECT label, count(*) AS n FROM read_zarr('{embeddings}', array_path='/label/') GROUP BY label", "SELECT label, count(*) AS n FROM embeddings GROUP BY label"),
    "scan_array_alias": ("SELECT count(DISTINCT vec) AS n FROM read_zarr('{embeddings}', \"array\"='embedding')", "SELECT count(DISTINCT vec_id) AS n FROM embeddings"),
    "scan_version_2": ("SELECT orderkey, custkey, orderdate FROM '{orders}'", "SELECT o_orderkey AS orderkey, o_custkey AS custkey, epoch_us(o_orderdate) AS orderdate FROM orders"),
    "packed_decode": ("SELECT linenumber, round(sum(discount), 2) AS s, count(tax) AS n FROM '{lineitem}' GROUP BY linenumber", "SELECT l_linenumber AS linenumber, round(sum(round(l_discount * 100)) / 100, 2) AS s, count(*) FILTER (WHERE round(l_tax * 100) <> 0) AS n FROM lineitem GROUP BY l_linenumber"),
    "null_cells": ("SELECT kind, count(*) AS cells, count(n) AS filled, sum(n) AS events FROM '{events}' WHERE user >= 0 GROUP BY kind", "WITH k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS kind FROM (SELECT DISTINCT event_type FROM events)) SELECT kind::BIGINT AS kind, (SELECT count(DISTINCT user_id) FROM events) AS cells, count(DISTINCT user_id) AS filled, count(*) AS events FROM events JOIN k USING (event_type) GROUP BY kind"),
    "is_null": ("SELECT count(*) AS n FROM '{events}' WHERE n IS NULL", "SELECT (SELECT count(DISTINCT user_id) * count(DISTINCT event_type) FROM events) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)) AS n"),
    "filter_coordinate": ("SELECT count(*) AS n, sum(custkey) AS c FROM '{orders}' WHERE orderkey >= 100 AND orderkey < 1200", "SELECT count(*) AS n, sum(o_custkey)::BIGINT AS c FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 1200"),
    "filter_between_or": ("SELECT count(*) AS n FROM '{lineitem}' WHERE quantity BETWEEN 10 AND 20 OR linenumber = 1", "SELECT count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 OR l_linenumber = 1"),
    "filter_subquery": ("SELECT count(*) AS n FROM '{lineitem}' WHERE quantity > (SELECT avg(quantity) FROM '{lineitem}')", "SELECT count(*) AS n FROM lineitem WHERE l_quantity > (SELECT avg(l_quantity) FROM lineitem)"),
    "aggregate_group": ("SELECT returnflag, linestatus, sum(quantity) AS q, avg(quantity) AS a, min(price) AS lo, max(price) AS hi, count(*) AS n FROM '{lineitem}' GROUP BY returnflag, linestatus", "SELECT ascii(l_returnflag)::SMALLINT AS returnflag, ascii(l_linestatus)::SMALLINT AS linestatus, sum(l_quantity) AS q, avg(l_quantity) AS a, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS n FROM lineitem GROUP BY 1, 2"),
    "aggregate_filter": ("SELECT d, count(*) FILTER (WHERE embedding > 0) AS n FROM read_zarr('{embeddings}', dims=['vec','d']) GROUP BY d", "SELECT CAST(d AS BIGINT) AS d, count(*) FILTER (WHERE embedding[d + 1] > 0) AS n FROM embeddings, range(0, (SELECT max(len(embedding)) FROM embeddings)) r(d) GROUP BY d"),
    "aggregate_alias": ("SELECT linenumber % 3 AS part, count(DISTINCT suppkey) AS n FROM '{lineitem}' GROUP BY part HAVING count(*) > 1", "SELECT l_linenumber % 3 AS part, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY part HAVING count(*) > 1"),
    "distinct_cross": ("SELECT a.x AS x, b.y AS y FROM (SELECT DISTINCT returnflag AS x FROM '{lineitem}') a CROSS JOIN (SELECT DISTINCT linestatus AS y FROM '{lineitem}') b", "SELECT a.x, b.y FROM (SELECT DISTINCT ascii(l_returnflag)::SMALLINT AS x FROM lineitem) a CROSS JOIN (SELECT DISTINCT ascii(l_linestatus)::SMALLINT AS y FROM lineitem) b"),
    "join_groups": ("SELECT l.label, count(*) AS n, max(e.embedding)::DOUBLE AS hi FROM read_zarr('{embeddings}', dims='vec,d') e JOIN read_zarr('{embeddings}', dims='vec') l ON e.vec = l.vec WHERE e.d < 8 GROUP BY l.label", "SELECT label, count(*) AS n, max(CAST(embedding[d + 1] AS DOUBLE)) AS hi FROM embeddings, range(0, 8) r(d) GROUP BY label"),
    "join_stores": ("SELECT l.linenumber, count(*) AS n, sum(l.quantity) AS q FROM '{lineitem}' l JOIN '{orders}' o ON l.orderkey = o.orderkey WHERE o.totalprice > 200000 GROUP BY l.linenumber", "SELECT l_linenumber AS linenumber, count(*) AS n, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 200000 GROUP BY 1"),
    "window_rank_qualify": ("SELECT suppkey, sum(quantity) AS q, rank() OVER (ORDER BY sum(quantity) DESC) AS r FROM '{lineitem}' GROUP BY suppkey QUALIFY r <= 5", "SELECT l_suppkey AS suppkey, sum(l_quantity) AS q, rank() OVER (ORDER BY sum(l_quantity) DESC) AS r FROM lineitem GROUP BY 1 QUALIFY r <= 5"),
    "window_row_number": ("SELECT custkey, orderkey FROM (SELECT custkey, orderkey, row_number() OVER (PARTITION BY custkey ORDER BY orderdate DESC, orderkey) AS r FROM '{orders}') WHERE r = 1", "SELECT o_custkey AS custkey, o_orderkey AS orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1"),
    "window_lag": ("SELECT custkey, orderkey, orderkey - lag(orderkey) OVER (PARTITION BY custkey ORDER BY orderkey) AS gap FROM '{orders}'", "SELECT o_custkey AS custkey, o_orderkey AS orderkey, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS gap FROM orders"),
    "top_k": ("SELECT orderkey, totalprice FROM '{orders}' ORDER BY totalprice DESC, orderkey LIMIT 10", "SELECT o_orderkey AS orderkey, o_totalprice AS totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "limit_rows": ("SELECT count(*) AS n FROM (SELECT * FROM '{lineitem}' LIMIT 100)", "SELECT count(*) AS n FROM (SELECT * FROM lineitem LIMIT 100)"),
    "cte_subquery": ("WITH s AS (SELECT suppkey, sum(quantity) AS q FROM '{lineitem}' GROUP BY suppkey) SELECT suppkey, q FROM s WHERE q > (SELECT avg(q) FROM s)", "WITH s AS (SELECT l_suppkey AS suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT suppkey, q FROM s WHERE q > (SELECT avg(q) FROM s)"),
    "round_cast": ("SELECT linenumber, round(max(price)::DOUBLE - min(price)::DOUBLE, 2) AS span, max(price) > min(price) AS wide FROM '{lineitem}' GROUP BY linenumber", "SELECT l_linenumber AS linenumber, round(max(l_extendedprice) - min(l_extendedprice), 2) AS span, max(l_extendedprice) > min(l_extendedprice) AS wide FROM lineitem GROUP BY 1"),
    "metadata": ("SELECT name, dims, dtype, role FROM read_zarr_metadata('{embeddings}')", "SELECT * FROM (VALUES ('embedding', '[\"vec\",\"d\"]', 'float32', 'data'), ('label', '[\"vec\"]', 'int32', 'data'), ('vec', '[\"vec\"]', 'int64', 'coord')) t(name, dims, dtype, role)"),
    "metadata_one": ("SELECT name, role FROM read_zarr_metadata('{orders}', array_path='custkey')", "SELECT 'custkey' AS name, 'data' AS role"),
    "cube_average": ("SELECT lat, lon, avg(qty) AS a, sum(n) AS n FROM read_zarr('{cube}', dims='time,lat,lon') GROUP BY lat, lon", _CELLS + "SELECT (50 - 10 * j)::DOUBLE AS lat, 2.5 * k::DOUBLE AS lon, avg(q) AS a, sum(n)::BIGINT AS n FROM s GROUP BY j, k"),
    "cube_levels": ("SELECT level, count(*) AS cells, sum(by_level) AS q FROM read_zarr('{cube}', dims=['time','level','lat','lon']) WHERE lat BETWEEN 10 AND 30 AND level > 300 AND time < 6 GROUP BY level", _CELLS + "SELECT (l * 100)::INT AS level, 6 * 3 * 8::BIGINT AS cells, sum(q) AS q FROM c WHERE l > 3 AND t < 6 AND j BETWEEN 2 AND 4 GROUP BY l"),
    "cube_join": ("SELECT a.time, a.lat, a.lon, a.qty, b.by_level AS low FROM read_zarr('{cube}', dims='time,lat,lon') a JOIN read_zarr('{cube}', dims='time,level,lat,lon') b ON a.time = b.time AND a.lat = b.lat AND a.lon = b.lon WHERE b.level = 100 AND b.by_level IS NOT NULL AND a.lon < 12", _CELLS + "SELECT t::BIGINT AS time, (50 - 10 * j)::DOUBLE AS lat, 2.5 * k::DOUBLE AS lon, s.q AS qty, c.q AS low FROM s JOIN c USING (t, j, k) WHERE l = 1 AND k < 5"),
    "cube_nan": ("SELECT count(*) AS n FROM read_zarr('{cube}', array_path='odd') WHERE odd = 'NaN'::DOUBLE", _CELLS + "SELECT count(*) AS n FROM s WHERE j = 0"),
    "cube_nested": ("SELECT lat, lon, \"deep/inner/share\" AS n FROM read_zarr('{cube}', array_path='deep/inner/share') WHERE \"deep/inner/share\" > 0", _CELLS + "SELECT (50 - 10 * j)::DOUBLE AS lat, 2.5 * k::DOUBLE AS lon, sum(n)::BIGINT AS n FROM s GROUP BY j, k"),
    "cube_metadata": ("SELECT name, dims, dtype, shape, chunk_shape, role FROM read_zarr_metadata('{cube}')", "SELECT * FROM (VALUES " + ", ".join(map(str, [("area", '["lat","lon"]', "float64", "[6,8]", "[6,8]", "aux_coord"), ("by_level", '["time","level","lat","lon"]', "float64", "[12,7,6,8]", "[5,7,4,8]", "data"), ("crs", "[]", "int32", "[]", "[]", "scalar"), ("deep/inner/share", '["lat","lon"]', "int64", "[6,8]", "[4,4]", "data"), ("lat", '["lat"]', "float64", "[6]", "[4]", "coord"), ("level", '["level"]', "int32", "[7]", "[7]", "coord"), ("lon", '["lon"]', "float64", "[8]", "[8]", "coord"), ("n", '["time","lat","lon"]', "int32", "[12,6,8]", "[4,6,8]", "data"), ("odd", '["time","lat","lon"]', "float64", "[12,6,8]", "[4,6,8]", "data"), ("qty", '["time","lat","lon"]', "float64", "[12,6,8]", "[4,6,8]", "data"), ("time", '["time"]', "int64", "[12]", "[12]", "coord"), ("time_bnds", '["time","nv"]', "int64", "[12,2]", "[12,2]", "bounds")])) + ") t(name, dims, dtype, shape, chunk_shape, role)"),
    "cube_groups": ("SELECT dims, shape, chunk_shape, data_vars, coord_vars FROM read_zarr_groups('{cube}')", "SELECT * FROM (VALUES " + ", ".join(map(str, [('["lat","lon"]', "[6,8]", "[4,4]", '["deep/inner/share"]', '["lat","lon"]'), ('["time","lat","lon"]', "[12,6,8]", "[4,6,8]", '["n","odd","qty"]', '["time","lat","lon"]'), ('["time","level","lat","lon"]', "[12,7,6,8]", "[5,7,4,8]", '["by_level"]', '["time","level","lat","lon"]')])) + ") t(dims, shape, chunk_shape, data_vars, coord_vars)"),
    "groups": ("SELECT dims, data_vars, coord_vars FROM read_zarr_groups('{embeddings}')", "SELECT * FROM (VALUES ('[\"vec\",\"d\"]', '[\"embedding\"]', '[\"vec\"]'), ('[\"vec\"]', '[\"label\"]', '[\"vec\"]')) t(dims, data_vars, coord_vars)"),
}


def _text(spark: SparkSession, sf_dir: str, query: str) -> str:
    for table in _STORES:
        if "{" + table + "}" in query:
            query = query.replace("{" + table + "}", store(spark, sf_dir, table))
    return query


def join_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store joined with a plain table."""
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("demo_customer")
    return sql(spark, _text(spark, sf_dir, "SELECT c_mktsegment AS segment, count(*) AS n FROM '{orders}' o JOIN demo_customer ON custkey = c_custkey GROUP BY 1"))


def queries() -> dict:
    found = {f"zarr_{k}": functools.partial(lambda spark, sf_dir, text: sql(spark, _text(spark, sf_dir, text)), text=v[0]) for k, v in QUERIES.items()}
    return found | {"zarr_join_parquet": join_parquet}


def oracle_sql() -> dict[str, str]:
    found = {f"zarr_{k}": v[1] for k, v in QUERIES.items()}
    return found | {"zarr_join_parquet": "SELECT c_mktsegment AS segment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"}
