"""read_zarr, read_zarr_metadata and read_zarr_groups.

The metadata functions read JSON documents alone, on the driver: their rows are as many as the
store has arrays."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..plans import tables
from ..shipping import ship
from ..sources.datasource import ZarrDataSource
from ..sources.stores import open_store


def register(spark: SparkSession) -> None:
    """Make the source "zarr" and the SQL table functions known to the session."""
    if getattr(spark, "_gridspark_registered", False):
        return
    ship(spark)
    spark.dataSource.register(ZarrDataSource)
    spark.udtf.register("read_zarr", udtf(ReadZarr))
    spark.udtf.register("read_zarr_metadata", udtf(ReadZarrMetadata, returnType=tables.METADATA))
    spark.udtf.register("read_zarr_groups", udtf(ReadZarrGroups, returnType=tables.GROUPS))
    spark._gridspark_registered = True


def read_zarr(spark: SparkSession, path: str, dims: str | list | None = None, array: str | None = None, array_path: str | None = None, columns: list[str] | None = None, ranges: dict | None = None, **options: str) -> DataFrame:
    """A store's table as a DataFrame. columns: read and decode these alone. ranges: coordinate to
    (least, largest) or None; chunks without such values are not read. It does not filter rows."""
    register(spark)
    tables.choose(open_store(path, options), path, dims, array, array_path)  # requests that can't be met fail here, in plain words
    reader = spark.read.format("zarr").options(**options)
    wanted = tables.parse_dims(dims)
    given = {"dims": None if wanted is None else json.dumps(wanted), "array": array, "array_path": array_path, "columns": None if columns is None else json.dumps(columns), "ranges": json.dumps(ranges) if ranges else None}
    for k, v in given.items():
        if v is not None:
            reader = reader.option(k, v)
    return reader.load(path)


def read_zarr_metadata(spark: SparkSession, path: str, array: str | None = None, array_path: str | None = None, **options: str) -> DataFrame:
    """name, dims, dtype, shape, chunk_shape, attrs, role of every array; lists as compact JSON."""
    return spark.createDataFrame(tables.metadata_rows(open_store(path, options), array, array_path), tables.METADATA)


def read_zarr_groups(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """dims, shape, chunk_shape, data_vars, coord_vars of every different group of data arrays."""
    return spark.createDataFrame(tables.group_rows(open_store(path, options)), tables.GROUPS)


# --- SQL table functions; named arguments as name => value ---------------------------------


class ReadZarr:
    """The whole scan in one task: for small stores in plain spark.sql. sql() and the source "zarr"
    scan in parallel."""

    @staticmethod
    def analyze(path: AnalyzeArgument, dims: AnalyzeArgument | None = None, array: AnalyzeArgument | None = None, array_path: AnalyzeArgument | None = None) -> AnalyzeResult:
        value = lambda a: None if a is None else a.value
        return AnalyzeResult(tables.choose(open_store(path.value), path.value, value(dims), value(array), value(array_path)).schema())

    def eval(self, path: str, dims: object = None, array: str | None = None, array_path: str | None = None) -> Iterator[tuple]:
        from ..sources.datasource import Range, ZarrReader

        store = open_store(path)
        table = tables.choose(store, path, dims, array, array_path)
        reader = ZarrReader(store, table, table.columns)
        for part in reader.partitions():
            for batch in reader.read(Range(part.start, part.stop)):
                yield from zip(*(c.to_pylist() for c in batch.columns))


class ReadZarrMetadata:
    def eval(self, path: str, array: str | None = None, array_path: str | None = None) -> Iterator[tuple]:
        yield from tables.metadata_rows(open_store(path), array, array_path)


class ReadZarrGroups:
    def eval(self, path: str) -> Iterator[tuple]:
        yield from tables.group_rows(open_store(path))
