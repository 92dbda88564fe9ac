"""Array metadata of Zarr versions 2 and 3, and the decoding of chunks to numpy."""

from __future__ import annotations

import base64
import json
import struct
import zlib
from dataclasses import dataclass, field
from itertools import product
from math import prod

import numpy as np

from ..errors import ZarrError
from . import blosc
from .stores import LocalStore

#: Element types that can be read (fixed values), by numpy code.
KINDS = {"bool": "b1", "int8": "i1", "int16": "i2", "int32": "i4", "int64": "i8", "uint8": "u1", "uint16": "u2", "uint32": "u4", "uint64": "u8", "float32": "f4", "float64": "f8"}
ALIASES = {"float": "float32", "double": "float64"}
_OF_CODE = {v: k for k, v in KINDS.items()}


@dataclass(frozen=True)
class ArrayMeta:
    """What a reader needs of one array; small, and the same for every task."""

    name: str
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    kind: str  # as stored; perhaps one that can't be read
    order: str
    fill: object  # the array's fill value as JSON has it, or None
    codecs: tuple  # for version 3 as JSON has them; for version 2 (filters, compressor)
    version: int
    separator: str
    prefix: str  # of chunk keys
    dims: tuple[str, ...] | None
    attrs: dict = field(hash=False, compare=False)

    def dtype(self) -> np.dtype:
        kind = ALIASES.get(self.kind, self.kind)
        if kind not in KINDS:
            raise ZarrError(f"unsupported dtype '{self.kind}' for array '{self.name}'")
        return np.dtype("<" + KINDS[kind])

    def fill_value(self) -> np.generic:
        return parse_fill(self.fill, self.dtype())

    def grid(self) -> tuple[int, ...]:
        return tuple(-(-n // c) if n else 0 for n, c in zip(self.shape, self.chunks))

    def key(self, index: tuple[int, ...]) -> str:
        if not index:
            return f"{self.name}/{'c' if self.prefix else '0'}"
        return f"{self.name}/{self.prefix}{self.separator.join(map(str, index))}"


def parse_fill(value: object, dtype: np.dtype) -> np.generic:
    if value is None:
        return np.zeros((), dtype)[()]
    if isinstance(value, str):
        if value.startswith("0x"):
            return np.frombuffer(int(value, 16).to_bytes(dtype.itemsize, "little"), dtype)[0]
        if dtype.kind == "f":
            return dtype.type(float(value.replace("Infinity", "inf")))
        if value in ("true", "false"):
            return dtype.type(value == "true")
        raw = base64.b64decode(value)
        return np.frombuffer(raw, dtype)[0] if len(raw) == dtype.itemsize else np.zeros((), dtype)[()]
    with np.errstate(all="ignore"):
        return np.array(value).astype(dtype)[()]


def _labels(given: object, attrs: dict) -> tuple[str, ...] | None:
    names = given if given is not None else attrs.get("_ARRAY_DIMENSIONS")
    if not isinstance(names, list):
        return None
    return tuple(n if isinstance(n, str) else f"dim_{i}" for i, n in enumerate(names))


def parse_v3(name: str, meta: dict) -> ArrayMeta:
    grid = meta.get("chunk_grid", {})
    if grid.get("name") != "regular":
        raise ZarrError(f"array '{name}' has a chunk grid '{grid.get('name')}'; only regular grids can be read")
    keys = meta.get("chunk_key_encoding", {"name": "default"})
    given = keys.get("configuration") or {}
    default = keys.get("name", "default") == "default"
    separator = given.get("separator", "/" if default else ".")
    kind = meta["data_type"]
    kind = kind.split(" / ")[0].strip() if isinstance(kind, str) else str(kind.get("name") if isinstance(kind, dict) else kind)
    attrs = meta.get("attributes") or {}
    return ArrayMeta(name, tuple(meta["shape"]), tuple(grid["configuration"]["chunk_shape"]), kind, "C", meta.get("fill_value"), tuple(meta.get("codecs", ())), 3, separator, f"c{separator}" if default else "", _labels(meta.get("dimension_names"), attrs), attrs)


def parse_v2(name: str, meta: dict, attrs: dict) -> ArrayMeta:
    code = meta["dtype"]
    kind = _OF_CODE.get(code[1:], code) if isinstance(code, str) else str(code)
    endian = "big" if isinstance(code, str) and code[:1] == ">" else "little"
    return ArrayMeta(name, tuple(meta["shape"]), tuple(meta["chunks"]), kind, meta.get("order", "C"), meta.get("fill_value"), (meta.get("filters") or (), meta.get("compressor"), endian), 2, meta.get("dimension_separator", "."), "", _labels(None, attrs), attrs)


def load_meta(store, name: str) -> ArrayMeta:  # noqa: ANN001
    found, two = store.get(f"{name}/zarr.json"), None
    if found is None:
        two = store.get(f"{name}/.zarray")
        if two is None:
            raise ZarrError(f"array '{name}' has no metadata")
    try:
        if two is None:
            return parse_v3(name, json.loads(found))
        attrs = store.get(f"{name}/.zattrs")
        return parse_v2(name, json.loads(two), json.loads(attrs) if attrs else {})
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        if isinstance(e, ZarrError):
            raise
        raise ZarrError(f"the metadata of array '{name}' can't be read: {e!r}") from e


_CRC_TABLE: np.ndarray | None = None


def crc32c(data: bytes) -> int:
    global _CRC_TABLE
    if _CRC_TABLE is None:
        table = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0x82F63B78), table >> np.uint32(1))
        _CRC_TABLE = table
    table, crc = _CRC_TABLE.tolist(), 0xFFFFFFFF
    for b in data:
        crc = table[(crc ^ b) & 255] ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


def _bytes_step(name: str, given: dict, data: bytes) -> bytes:
    if name in ("gzip", "zlib"):
        return zlib.decompress(data, 47)
    if name == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if name == "blosc":
        return blosc.decode(data)
    if name == "lz4":
        import pyarrow as pa

        return pa.Codec("lz4_raw").decompress(data[4:], decompressed_size=struct.unpack_from("<I", data)[0], asbytes=True)
    if name == "bz2":
        import bz2

        return bz2.decompress(data)
    if name == "lzma":
        import lzma

        return lzma.decompress(data)
    if name == "crc32c":
        body, (said,) = data[:-4], struct.unpack("<I", data[-4:])
        if crc32c(body) != said:
            raise ZarrError("a chunk fails its crc32c check")
        return body
    if name == "shuffle":
        return blosc._unshuffled(data, int(given.get("elementsize", 4)))
    raise ZarrError(f"unsupported codec '{name}'")


def _name(codec: object) -> tuple[str, dict]:
    if isinstance(codec, str):
        return codec, {}
    name = codec["name"].removeprefix("numcodecs.").removeprefix("zarrs.")
    return name, codec.get("configuration") or {}


def decode_v3(data: bytes, codecs: tuple, shape: tuple[int, ...], dtype: np.dtype, fill: np.generic) -> np.ndarray:
    """A chunk's bytes to an array of `shape`, back through its codecs."""
    forward, at = [], shape  # shapes as the encoder met them
    for codec in codecs:
        name, given = _name(codec)
        forward.append((name, given, at))
        if name == "transpose":
            order = given["order"]
            order = list(range(len(at))) if order == "C" else list(range(len(at)))[::-1] if order == "F" else order
            at = tuple(at[i] for i in order)
            forward[-1] = (name, {"order": order}, at)
    value: object = data
    for name, given, at in reversed(forward):
        if name == "transpose":
            value = np.transpose(value, np.argsort(given["order"]))
        elif name in ("bytes", "endian"):
            kind = dtype.newbyteorder(">") if given.get("endian") == "big" else dtype
            value = np.frombuffer(value, kind, prod(at)).reshape(at)
        elif name == "sharding_indexed":
            value = _shard(value, given, at, dtype, fill)
        else:
            value = _bytes_step(name, given, value)
    return value.astype(dtype, copy=False)


def _shard_index(given: dict, shape: tuple[int, ...], take) -> np.ndarray | None:  # noqa: ANN001
    """Offset and length of each inner chunk; take(start, length) gives bytes of the shard."""
    counts = tuple(n // c for n, c in zip(shape, given["chunk_shape"]))
    codecs = tuple(given.get("index_codecs") or ({"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}))
    size = prod(counts) * 16 + 4 * sum(_name(c)[0] == "crc32c" for c in codecs)
    raw = take(0 if given.get("index_location", "end") == "start" else -size, size)
    return None if raw is None else decode_v3(raw, codecs, (*counts, 2), np.dtype("<u8"), np.uint64(0))


def _shard_part(given: dict, index: np.ndarray, take, region: tuple[slice, ...], dtype: np.dtype, fill: np.generic) -> np.ndarray:  # noqa: ANN001
    """A region of a shard, from the inner chunks that it meets."""
    inner = tuple(given["chunk_shape"])
    out = np.full(tuple(r.stop - r.start for r in region), fill, dtype)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    for at in product(*[range(r.start // c, -(-r.stop // c)) for r, c in zip(region, inner)]):
        offset, length = index[at]
        if offset == none and length == none:
            continue
        part = decode_v3(take(int(offset), int(length)), tuple(given["codecs"]), inner, dtype, fill)
        low = [max(r.start, i * c) for r, i, c in zip(region, at, inner)]
        high = [min(r.stop, (i + 1) * c) for r, i, c in zip(region, at, inner)]
        out[tuple(slice(a - r.start, z - r.start) for a, z, r in zip(low, high, region))] = part[tuple(slice(a - i * c, z - i * c) for a, z, i, c in zip(low, high, at, inner))]
    return out


def _shard(data: bytes, given: dict, shape: tuple[int, ...], dtype: np.dtype, fill: np.generic) -> np.ndarray:
    take = lambda start, length: data[start:][:length]
    return _shard_part(given, _shard_index(given, shape, take), take, tuple(slice(0, n) for n in shape), dtype, fill)


def decode_v2(data: bytes, meta: ArrayMeta, dtype: np.dtype) -> np.ndarray:
    filters, compressor, endian = meta.codecs
    if compressor is not None:
        data = _bytes_step(compressor["id"], compressor, data)
    for f in reversed(filters):
        data = _bytes_step(f["id"], f, data)
    kind = dtype.newbyteorder(">") if endian == "big" else dtype
    return np.frombuffer(data, kind, prod(meta.chunks)).reshape(meta.chunks, order=meta.order).astype(dtype, copy=False)


def read_chunk(store, meta: ArrayMeta, index: tuple[int, ...], region: tuple[slice, ...] | None = None) -> np.ndarray:  # noqa: ANN001
    """The part of a chunk inside the array, or a region of it; a chunk that was never written has the
    fill value. Of a shard, the inner chunks that are not asked for are neither fetched nor decoded."""
    region = region or tuple(slice(0, min(c, n - i * c)) for i, c, n in zip(index, meta.chunks, meta.shape))
    dtype, key = meta.dtype(), meta.key(index)
    try:
        name, given = _name(meta.codecs[0]) if meta.version == 3 and len(meta.codecs) == 1 else ("", {})
        if name == "sharding_indexed" and any(r.start >= c or r.stop <= n - c for r, c, n in zip(region, given["chunk_shape"], meta.chunks)):
            take = lambda start, length: store.get_range(key, start, length)
            where = _shard_index(given, meta.chunks, take)
            return _unwritten(store, meta, index, region) if where is None else _shard_part(given, where, take, region, dtype, meta.fill_value())
        data = store.get(key)
        if data is None:
            return _unwritten(store, meta, index, region)
        return (decode_v2(data, meta, dtype) if meta.version == 2 else decode_v3(data, meta.codecs, meta.chunks, dtype, meta.fill_value()))[region]
    except ZarrError as e:
        raise ZarrError(f"array '{meta.name}', chunk {index}: {e}") from e


def _unwritten(store, meta: ArrayMeta, index: tuple[int, ...], region: tuple[slice, ...]) -> np.ndarray:  # noqa: ANN001
    # a machine that doesn't see the store's folder must not take that for chunks never written
    own = f"{meta.name}/{'.zarray' if meta.version == 2 else 'zarr.json'}"
    if isinstance(store, LocalStore) and store.get(own) is None:
        raise ZarrError(f"no '{own}' under '{store.root}' on this machine; local stores must be in a folder that all executors share")
    return np.full(tuple(r.stop - r.start for r in region), meta.fill_value(), meta.dtype())


class ChunkCache:
    """Decoded chunks of coordinates that a task reads again and again, the latest ones: up to `most`
    bytes, or one chunk."""

    def __init__(self, most: int = 32 << 20):
        self.most, self.held, self.size = most, {}, 0

    def read(self, store, meta: ArrayMeta, index: tuple[int, ...]) -> np.ndarray:  # noqa: ANN001
        key = meta.name, index
        if key in self.held:
            value = self.held.pop(key)
        else:
            value = np.ascontiguousarray(read_chunk(store, meta, index))
            self.size += value.nbytes
        self.held[key] = value
        while self.size > self.most and len(self.held) > 1:
            self.size -= self.held.pop(next(iter(self.held))).nbytes
        return value


def read_slice(store, meta: ArrayMeta, start: int, stop: int, cache: ChunkCache | None = None) -> np.ndarray:  # noqa: ANN001
    """Elements start to stop of an array of one dimension; only their chunks are read, once with a
    cache, and only their inner chunks of shards."""
    size = meta.chunks[0]
    sharded = meta.version == 3 and len(meta.codecs) == 1 and _name(meta.codecs[0])[0] == "sharding_indexed"
    parts = []
    for i in range(start // size, -(-stop // size)):
        region = (slice(max(0, start - i * size), min(size, stop - i * size, meta.shape[0] - i * size)),)
        parts.append(cache.read(store, meta, (i,))[region] if cache is not None and not sharded else read_chunk(store, meta, (i,), region))
    return np.concatenate(parts) if parts else np.empty(0, meta.dtype())
