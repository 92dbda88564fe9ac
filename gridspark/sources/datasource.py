"""The Spark data source "zarr".

Options: path, dims, array, array_path, columns (JSON list: read these alone, in this order), ranges
(JSON object, coordinate to [least, largest] or null: chunks without such values are left out; rows
are not filtered by it), reference (any mark, to tell scans apart).

A scan's partitions are ranges of numbers over the chunks that are left, some megabytes of
decoded cells each. Their description does not grow with the data: executors read their chunks,
and the slices of coordinates they need, from the store themselves."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..errors import ZarrError
from ..plans.tables import Column, Table, choose
from .arrays import ChunkCache
from .stores import open_store

#: Decoded bytes of a partition, and partitions of a scan, about.
PARTITION_BYTES, MOST_PARTITIONS = 8 << 20, 100_000


@dataclass
class Range(InputPartition):
    start: int
    stop: int


class ZarrReader(DataSourceReader):
    def __init__(self, store, table: Table, columns: tuple[Column, ...], ranges: dict | None = None):  # noqa: ANN001
        from ..plans.pruning import kept_chunks

        self.store, self.table, self.columns = store, table, columns
        self.kept: list[np.ndarray] | None = kept_chunks(store, table, ranges) if ranges else None

    def _axes(self) -> list[np.ndarray]:
        if self.kept is not None:
            return self.kept
        return [np.arange(-(-n // c) if n else 0) for n, c in zip(self.table.shape, self.table.chunks)]

    def partitions(self) -> list[Range]:
        total = prod(len(a) for a in self._axes())
        width = sum(8 if c.meta is None else c.meta.dtype().itemsize for c in self.columns)
        each = max(1, PARTITION_BYTES // max(1, prod(self.table.chunks) * width), -(-total // MOST_PARTITIONS))
        return [Range(a, min(total, a + each)) for a in range(0, total, each)] or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        from ..operators.pivot import chunk_batches

        axes, cache = self._axes(), ChunkCache()
        sizes = tuple(len(a) for a in axes)
        for n in range(partition.start, partition.stop):
            at = np.unravel_index(n, sizes) if sizes else ()
            yield from chunk_batches(self.store, self.table, self.columns, tuple(int(a[i]) for a, i in zip(axes, at)), cache)


class ZarrDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zarr"

    def _opened(self):  # noqa: ANN202
        path = self.options.get("path")
        if not path:
            raise ZarrError("the zarr source needs a path")
        known = {"path", "dims", "array", "array_path", "columns", "ranges", "reference"}
        store = open_store(path, {k: v for k, v in self.options.items() if k not in known})
        return store, choose(store, path, self.options.get("dims"), self.options.get("array"), self.options.get("array_path"))

    def _columns(self, table: Table, names: list[str]) -> tuple[Column, ...]:
        by = {c.name: c for c in table.columns}
        if missing := [n for n in names if n not in by]:
            raise ZarrError(f"no column {missing[0]!r}; columns: {json.dumps(list(by))}")
        return tuple(by[n] for n in names)

    def _asked(self, table: Table) -> tuple[Column, ...]:
        return self._columns(table, json.loads(self.options["columns"])) if self.options.get("columns") else table.columns

    def schema(self) -> StructType:
        _, table = self._opened()
        asked = self._asked(table)
        return StructType([f for c in asked for f in table.schema() if f.name == c.name])

    def reader(self, schema: StructType) -> ZarrReader:
        store, table = self._opened()
        columns = self._columns(table, schema.names)
        return ZarrReader(store, table, columns, json.loads(self.options.get("ranges") or "{}"))
