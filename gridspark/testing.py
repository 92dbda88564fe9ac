"""A small writer of array stores, for fixtures and examples. Not a sink: `write_array` writes from
numpy, on one machine; `write_grid` writes a DataFrame's cells by Spark tasks, a chunk in each group,
to a folder that all executors share."""

from __future__ import annotations

import gzip
import json
import os
import struct
import uuid
import zlib
from dataclasses import dataclass
from itertools import product
from math import prod

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sources.arrays import KINDS, crc32c

_NAME = {v: k for k, v in KINDS.items()}


def blosc_lz4(data: bytes, width: int, shuffle: int = 1, block: int | None = None) -> bytes:
    """A Blosc buffer by LZ4: shuffle 0 none, 1 by bytes, 2 by bits; one stream a block."""
    block = block or max(1, len(data))
    parts = []
    for a in range(0, len(data), block):
        piece = data[a : a + block]
        whole = len(piece) // width * width
        if shuffle == 1:
            piece = np.frombuffer(piece[:whole], np.uint8).reshape(-1, width).T.tobytes() + piece[whole:]
        elif shuffle == 2:
            used = len(piece) // width // 8 * 8 * width
            bits = np.unpackbits(np.frombuffer(piece[:used], np.uint8), bitorder="little").reshape(-1, width * 8)
            piece = np.packbits(bits.T.reshape(-1), bitorder="little").tobytes() + piece[used:]
        packed = pa.Codec("lz4_raw").compress(piece, asbytes=True)
        packed = packed if len(packed) < len(piece) else piece
        parts.append(struct.pack("<i", len(packed)) + packed)
    starts, at = [], 16 + 4 * len(parts)
    for p in parts:
        starts.append(at)
        at += len(p)
    flags = (1 << 5) | 0x10 | {0: 0, 1: 1, 2: 4}[shuffle]
    return struct.pack("<BBBBIII", 2, 1, flags, width, len(data), block, at) + struct.pack(f"<{len(starts)}I", *starts) + b"".join(parts)


def _encode(value: np.ndarray, codecs: list[dict]) -> bytes:
    out: object = value
    for c in codecs:
        name, given = c["name"], c.get("configuration", {})
        if name == "transpose":
            out = np.transpose(out, given["order"])
        elif name == "bytes":
            out = np.ascontiguousarray(out).astype(out.dtype.newbyteorder(">" if given.get("endian") == "big" else "<")).tobytes()
        elif name == "gzip":
            out = gzip.compress(out, given.get("level", 5))
        elif name == "zstd":
            out = zstandard.ZstdCompressor(given.get("level", 3)).compress(out)
        elif name == "crc32c":
            out = out + struct.pack("<I", crc32c(out))
        elif name == "blosc":
            out = blosc_lz4(out, given.get("typesize", value.dtype.itemsize), {"noshuffle": 0, "shuffle": 1, "bitshuffle": 2}[given.get("shuffle", "shuffle")], given.get("blocksize"))
        elif name == "sharding_indexed":
            inner = tuple(given["chunk_shape"])
            counts = [n // k for n, k in zip(out.shape, inner)]
            start = given.get("index_location") == "start"
            body, index = b"", []
            shift = prod(counts) * 16 + 4 if start else 0
            for at in product(*map(range, counts)):
                part = out[tuple(slice(i * k, (i + 1) * k) for i, k in zip(at, inner))]
                if not part.any():
                    index += [2**64 - 1] * 2
                    continue
                data = _encode(part, given["codecs"])
                index += [shift + len(body), len(data)]
                body += data
            raw = np.array(index, "<u8").tobytes()
            raw += struct.pack("<I", crc32c(raw))
            out = raw + body if start else body + raw
        else:
            raise ValueError(name)
    return out


def _put(path: str, data: bytes | dict) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(json.dumps(data).encode() if isinstance(data, dict) else data)


def _chunks(value: np.ndarray, chunks: tuple[int, ...], fill: object, skip):  # noqa: ANN001, ANN202
    for at in product(*[range(-(-n // c)) for n, c in zip(value.shape, chunks)]):
        part = value[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks))]
        whole = np.full(chunks, fill, value.dtype)
        whole[tuple(slice(0, n) for n in part.shape)] = part
        if not (skip and skip(at)):
            yield at, whole


def write_group(root: str, attrs: dict | None = None) -> None:
    _put(f"{root}/zarr.json", {"zarr_format": 3, "node_type": "group", "attributes": attrs or {}})


def _describe(root: str, name: str, shape: tuple[int, ...], dtype: np.dtype, dims: list | None, chunks: tuple[int, ...], fill: object, attrs: dict | None, codecs: list[dict], **more: object) -> dict:
    json_fill = fill if isinstance(fill, str) else "NaN" if isinstance(fill, float) and fill != fill else fill
    meta = {"zarr_format": 3, "node_type": "array", "shape": list(shape), "data_type": _NAME[dtype.str[1:]], "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(chunks)}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": json_fill, "codecs": codecs, "attributes": attrs or {}, **more}
    if dims is not None:
        meta["dimension_names"] = dims
    _put(f"{root}/{name}/zarr.json", meta)
    return meta


_PLAIN = [{"name": "bytes", "configuration": {"endian": "little"}}]


def write_array(root: str, name: str, value: np.ndarray, dims: list | None, chunks: tuple[int, ...] | None = None, fill: object = 0, attrs: dict | None = None, codecs: list[dict] | None = None, skip=None, **more: object) -> dict:  # noqa: ANN001
    """A version 3 array; skip(index) leaves a chunk unwritten. Returns its metadata."""
    chunks = tuple(chunks or value.shape)
    codecs = codecs or _PLAIN
    meta = _describe(root, name, value.shape, value.dtype, dims, chunks, fill, attrs, codecs, **more)
    pad = 0 if isinstance(fill, str) else fill
    for at, whole in _chunks(value, chunks, pad, skip):
        _put(f"{root}/{name}/c" + "".join(f"/{i}" for i in at), _encode(whole, codecs))
    return meta


@dataclass(frozen=True)
class Spec:
    """An array of a grid: the column its cells come from (times as microseconds), and how it is stored.
    compressor: for version 2 alone."""

    name: str
    column: str
    dtype: str
    attrs: dict | None = None
    codecs: list | None = None
    fill: object = 0
    compressor: dict | None = None


def numbered(df: DataFrame, folder: str, order: str | None = None) -> DataFrame:
    """df with `i`, the place of each row from 0. Without `order` df must be Parquet files as they are
    read, and places are those of the rows in the files, which hold without writing anything. With
    it rows are first written to the shared folder in that order. The driver sees one count a file."""
    if order is not None:
        path = f"{folder}/rows-{uuid.uuid4().hex}"
        df.repartitionByRange(order).sortWithinPartitions(order).write.parquet(path)
        df = df.sparkSession.read.parquet(path)
    kept = df.withColumns({"_file": F.col("_metadata.file_path"), "_at": F.col("_metadata.row_index")})
    start, rows = 0, []
    for file, n in sorted(map(tuple, kept.groupBy("_file").count().collect())):
        rows.append((file, start))
        start += n
    starts = df.sparkSession.createDataFrame(rows, "_file string, _start long")
    return kept.join(F.broadcast(starts), "_file").withColumn("i", F.col("_start") + F.col("_at")).drop("_file", "_at", "_start")


def write_grid(df: DataFrame, root: str, dims: list[str], index: list[str], shape: tuple[int, ...], chunks: tuple[int, ...], arrays: list[Spec], version: int = 3, ordered: bool = False) -> None:
    """Arrays of one shape from rows of cells; index names the columns with a cell's places. Chunks
    without a cell are not written. A task holds one chunk's rows. ordered: most rows come by their
    first place; then chunks whose rows stand together are written where they are read, a row of chunks
    at a time, and only the others move."""
    for a in arrays:
        if version == 3:
            _describe(root, a.name, shape, np.dtype(a.dtype), dims, chunks, a.fill, a.attrs, a.codecs or _PLAIN)
        else:
            meta = {"zarr_format": 2, "shape": list(shape), "chunks": list(chunks), "dtype": np.dtype(a.dtype).str, "compressor": a.compressor, "filters": None, "fill_value": None, "order": "C", "dimension_separator": "."}
            _put(f"{root}/{a.name}/.zarray", meta)
            _put(f"{root}/{a.name}/.zattrs", {"_ARRAY_DIMENSIONS": dims, **(a.attrs or {})})
    chunk = [F.floor(F.col(i) / c).cast("long").alias(f"_c{k}") for k, (i, c) in enumerate(zip(index, chunks))]

    def put(cells: pa.Table) -> pa.Table:
        at = tuple(cells.column(f"_c{k}")[0].as_py() for k in range(len(chunks)))
        place = tuple(cells.column(f"_i{k}").to_numpy() - at[k] * chunks[k] for k in range(len(chunks)))
        for a in arrays:
            cell = cells.column(a.column)
            value = (cell.cast(pa.int64()).fill_null(-(1 << 63)) if pa.types.is_timestamp(cell.type) else cell).to_numpy()
            whole = np.full(chunks, a.fill, a.dtype)
            whole[place] = value.astype(a.dtype)
            if version == 3:
                _put(f"{root}/{a.name}/c" + "".join(f"/{i}" for i in at), _encode(whole, a.codecs or _PLAIN))
            else:
                data, kind = whole.tobytes(), (a.compressor or {}).get("id")
                data = zlib.compress(data) if kind == "zlib" else blosc_lz4(data, whole.dtype.itemsize) if kind == "blosc" else data
                _put(f"{root}/{a.name}/{'.'.join(map(str, at))}", data)
        return cells.slice(0, 1).select(["_c0"])

    def settle(held: list[pa.RecordBatch], at: int) -> list[pa.RecordBatch]:
        """Writes a whole row of chunks; of one with cells missing, the rows to pass on."""
        if sum(b.num_rows for b in held) != min(chunks[0], shape[0] - at * chunks[0]) * prod(shape[1:]):
            return held
        cells = pa.Table.from_batches(held)
        inner = [cells.column(f"_c{k}").to_numpy() for k in range(1, len(chunks))]
        for which in product(*[range(-(-n // c)) for n, c in zip(shape[1:], chunks[1:])]):
            put(cells.filter(pa.array(np.logical_and.reduce([x == i for x, i in zip(inner, which)]))) if which else cells)
        return []

    def straight(batches):  # noqa: ANN001, ANN202
        held: list[pa.RecordBatch] = []
        last = -1
        for b in batches:
            first = b.column("_c0").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(first)) + 1).tolist(), len(first)]
            for start, stop in zip(cuts, cuts[1:]):
                if start < stop and first[start] != last:
                    if held:
                        yield from settle(held, last)
                    held, last = [], int(first[start])
                held.append(b.slice(start, stop - start))
        if held:
            yield from settle(held, last)

    places: list[Column] = [F.col(i).alias(f"_i{k}") for k, i in enumerate(index)]
    rows = df.select(*chunk, *places, *dict.fromkeys(a.column for a in arrays))
    rows = rows.mapInArrow(straight, rows.schema) if ordered else rows
    rows.groupBy(*[f"_c{k}" for k in range(len(chunks))]).applyInArrow(put, "_c0 long").write.format("noop").mode("overwrite").save()


def write_v2_group(root: str) -> None:
    _put(f"{root}/.zgroup", {"zarr_format": 2})


def write_v2_array(root: str, name: str, value: np.ndarray, dims: list | None, chunks: tuple[int, ...] | None = None, fill: object = None, attrs: dict | None = None, compressor: dict | None = None, order: str = "C", separator: str = ".") -> dict:
    chunks = tuple(chunks or value.shape)
    meta = {"zarr_format": 2, "shape": list(value.shape), "chunks": list(chunks), "dtype": value.dtype.str, "compressor": compressor, "filters": None, "fill_value": fill, "order": order, "dimension_separator": separator}
    _put(f"{root}/{name}/.zarray", meta)
    _put(f"{root}/{name}/.zattrs", {**({} if dims is None else {"_ARRAY_DIMENSIONS": dims}), **(attrs or {})})
    for at, whole in _chunks(value, chunks, 0 if fill is None else fill, None):
        data = whole.tobytes(order=order)
        kind = (compressor or {}).get("id")
        data = gzip.compress(data) if kind == "gzip" else zlib.compress(data) if kind == "zlib" else zstandard.ZstdCompressor().compress(data) if kind == "zstd" else blosc_lz4(data, value.dtype.itemsize, compressor.get("shuffle", 1)) if kind == "blosc" else data
        _put(f"{root}/{name}/{separator.join(map(str, at)) or '0'}", data)
    return meta


def consolidate(root: str, metas: dict[str, dict]) -> None:
    """Root metadata that lists all arrays, as remote stores need."""
    _put(f"{root}/zarr.json", {"zarr_format": 3, "node_type": "group", "attributes": {}, "consolidated_metadata": {"kind": "inline", "must_understand": False, "metadata": metas}})
