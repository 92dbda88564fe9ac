"""From a store's arrays to one table: roles, dimension groups, columns and NULL rules."""

from __future__ import annotations

import base64
import binascii
import json
import struct
from dataclasses import dataclass

import numpy as np
from pyspark.sql import types as T

from ..errors import ZarrError
from ..sources.arrays import ArrayMeta, load_meta

#: Spark has no unsigned integers: each takes the next wider signed type.
SPARK_TYPES = {"b1": T.BooleanType(), "i1": T.ByteType(), "i2": T.ShortType(), "i4": T.IntegerType(), "i8": T.LongType(), "u1": T.ShortType(), "u2": T.IntegerType(), "u4": T.LongType(), "u8": T.DecimalType(20, 0), "f4": T.FloatType(), "f8": T.DoubleType()}


@dataclass(frozen=True)
class Column:
    """An output column. meta: its array, None for a dimension without coordinates. dim: the
    dimension's number, for coordinates. null: the raw value that is NULL. pack: scale, offset."""

    name: str
    dim: int | None
    meta: ArrayMeta | None
    null: object = None
    pack: tuple[float, float] | None = None

    def spark_type(self) -> T.DataType:
        if self.meta is None:
            return T.LongType()
        if self.pack:
            return T.DoubleType()
        return SPARK_TYPES[self.meta.dtype().str[1:]]


@dataclass(frozen=True)
class Table:
    """What one scan reads: all its variables share shape and chunks."""

    dims: tuple[str, ...]
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    columns: tuple[Column, ...]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark_type(), True) for c in self.columns])


def compact(value: object) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def load_all(store, names: list[str] | None = None) -> dict[str, ArrayMeta]:  # noqa: ANN001
    return {n: load_meta(store, n) for n in (store.array_names() if names is None else names)}


def load_one(store, names: list[str], name: str) -> dict[str, ArrayMeta]:  # noqa: ANN001
    """An array and what can be coordinates of it. Others are not parsed: they may be beyond reading."""
    meta = load_meta(store, name)
    asked = [p for d in meta.dims or () for p in _places(meta, d) if p in names and p != name]
    return {name: meta} | load_all(store, list(dict.fromkeys(asked)))


def _places(data: ArrayMeta, dim: str) -> tuple[str, str]:
    """Where a dimension's values may be: beside the array, or at the root."""
    return f"{data.name.rsplit('/', 1)[0]}/{dim}" if "/" in data.name else dim, dim


def _texts(metas: dict[str, ArrayMeta], attr: str) -> list[str]:
    return [v for m in metas.values() if isinstance(v := m.attrs.get(attr), str)]


def auxiliary(metas: dict[str, ArrayMeta]) -> set[str]:
    return {t for v in _texts(metas, "coordinates") for t in v.split()}


def bounds(metas: dict[str, ArrayMeta], aux: set[str]) -> set[str]:
    named = set(_texts(metas, "bounds"))
    return named | {n for n, m in metas.items() if n not in aux and n.endswith(("_bnds", "_bounds")) and len(m.shape) == 2 and m.shape[1] == 2}


def is_coordinate(meta: ArrayMeta) -> bool:
    return len(meta.shape) == 1 and meta.dims == (meta.name.rsplit("/", 1)[-1],)


def role(meta: ArrayMeta, aux: set[str], bound: set[str]) -> str:
    if meta.name in bound:
        return "bounds"
    if not meta.shape:
        return "scalar"
    if meta.name in aux:
        return "aux_coord"
    return "coord" if is_coordinate(meta) else "data"


def data_arrays(metas: dict[str, ArrayMeta]) -> list[ArrayMeta]:
    aux = auxiliary(metas)
    bound = bounds(metas, aux)
    return [m for m in metas.values() if role(m, aux, bound) == "data"]


def dims_of(meta: ArrayMeta) -> tuple[str, ...]:
    if meta.dims is None:
        raise ZarrError(f"array '{meta.name}' has no dimension_names or _ARRAY_DIMENSIONS")
    return meta.dims


def coordinate(metas: dict[str, ArrayMeta], data: ArrayMeta, dim: str) -> ArrayMeta | None:
    """The array of a dimension's values: beside the data array, else at the root."""
    for name in _places(data, dim):
        m = metas.get(name)
        if m is not None and len(m.shape) == 1 and m.dims == (dim,):
            return m
    return None


def packing(meta: ArrayMeta) -> tuple[float, float] | None:
    number = lambda k: float(v) if isinstance(v := meta.attrs.get(k), (int, float)) and not isinstance(v, bool) else None
    scale, offset = number("scale_factor"), number("add_offset")
    if meta.dtype().kind not in "iu" or (scale is None and offset is None):
        return None
    return (1.0 if scale is None else scale, 0.0 if offset is None else offset)


def _sentinel(value: object, kind: str) -> object:
    """An attribute as a raw value to compare with: a float, or an integer for integer arrays."""
    if isinstance(value, str):
        try:
            raw = base64.b64decode(value, validate=True)
        except (binascii.Error, ValueError):
            return None
        return struct.unpack("<d", raw)[0] if len(raw) == 8 else None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    if kind == "f":
        return float(value)
    return int(value) if float(value).is_integer() else None


def null_value(meta: ArrayMeta) -> object:
    """_FillValue, unless it is NaN and missing_value serves; else missing_value; else the array's
    own fill value unless that is nought. None: nothing is NULL. A float for an integer array (a
    text attribute gives one) matches nothing, and still keeps the fill value out."""
    dtype = meta.dtype()
    if dtype.kind == "b":
        return None
    fill, missing = _sentinel(meta.attrs.get("_FillValue"), dtype.kind), _sentinel(meta.attrs.get("missing_value"), dtype.kind)
    if fill is not None and not (isinstance(fill, float) and np.isnan(fill) and missing is not None):
        return fill
    if missing is not None:
        return missing
    if meta.fill is None:
        return None
    value = meta.fill_value()
    return None if value == 0 else value.item()


def _column(name: str, dim: int | None, meta: ArrayMeta | None) -> Column:
    return Column(name, dim, meta) if meta is None else Column(name, dim, meta, null_value(meta), packing(meta))


def _table(metas: dict[str, ArrayMeta], members: list[ArrayMeta]) -> Table:
    first = members[0]
    dims = dims_of(first) if first.shape else ()
    columns = [_column(d, i, coordinate(metas, first, d)) for i, d in enumerate(dims)]
    taken = {c.meta.name for c in columns if c.meta is not None}
    columns += [_column(m.name, None, m) for m in members if m.name not in taken]
    return Table(dims, first.shape, first.chunks, tuple(columns))


def groups(metas: dict[str, ArrayMeta]) -> dict[tuple[str, ...], list[ArrayMeta]]:
    """Data arrays by dimensions, in order; all of a group must share shape and chunks."""
    found: dict[tuple[str, ...], list[ArrayMeta]] = {}
    for m in data_arrays(metas):
        own = found.setdefault(dims_of(m), [])
        for what in ("shape", "chunks"):
            if own and getattr(own[0], what) != getattr(m, what):
                word = "array shape" if what == "shape" else "chunk shape"
                raise ZarrError(f"{word} mismatch in dim group {compact(m.dims)}: {compact(getattr(own[0], what))} of '{own[0].name}', {compact(getattr(m, what))} of '{m.name}'; use array_path= to select one array")
        own.append(m)
    return dict(sorted(found.items()))


def parse_dims(dims: str | list | tuple | None) -> tuple[str, ...] | None:
    """A list, a JSON array, or names between commas."""
    if dims is None or isinstance(dims, (list, tuple)):
        return None if dims is None else tuple(dims)
    text = dims.strip()
    if text.startswith("["):
        try:
            return tuple(json.loads(text))
        except json.JSONDecodeError:
            return tuple(p.strip().strip("'\"") for p in text.strip("[]").split(",") if p.strip())
    return tuple(p.strip() for p in text.split(",") if p.strip())


def one_name(array: str | None, array_path: str | None) -> str | None:
    if array is not None and array_path is not None:
        raise ZarrError("array and array_path mean the same: give one of them, not both")
    return array if array_path is None else array_path


def selected(names: list[str], asked: str) -> str:
    name = asked.strip().strip("/")
    if name not in names:
        raise ZarrError(f"array '{asked}' not found; available arrays: {compact(names)}")
    return name


def choose(store, path: str, dims=None, array: str | None = None, array_path: str | None = None) -> Table:  # noqa: ANN001
    """The table that a request means."""
    wanted, name = parse_dims(dims), one_name(array, array_path)
    names = store.array_names()
    if not names:
        raise ZarrError(f"no Zarr arrays found in '{path}'")
    if name is not None:
        metas = load_one(store, names, selected(names, name))
        meta = next(iter(metas.values()))
        own = dims_of(meta) if meta.shape or meta.dims is not None else ()
        if wanted is not None and wanted != own:
            raise ZarrError(f"array '{meta.name}' has dimensions {compact(own)}, not {compact(wanted)}")
        return _table(metas, [meta])
    metas = load_all(store, names)
    found = groups(metas)
    if not found:
        raise ZarrError(f"no data variables found in '{path}'")
    if wanted is not None:
        if wanted not in found:
            raise ZarrError(f"'{path}': no dimension group matches dims={compact(wanted)}; available: {compact(list(found))}")
        return _table(metas, found[wanted])
    if len(found) > 1:
        raise ZarrError(f"'{path}' contains multiple dimension groups, {compact(list(found))}: name the dimensions of one in dims, or a single array in array_path")
    return _table(metas, next(iter(found.values())))


METADATA = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "dims", "dtype", "shape", "chunk_shape", "attrs", "role")])
GROUPS = T.StructType([T.StructField(n, T.StringType()) for n in ("dims", "shape", "chunk_shape", "data_vars", "coord_vars")])


def metadata_rows(store, array: str | None = None, array_path: str | None = None) -> list[tuple[str, ...]]:  # noqa: ANN001
    """One row an array. Narrowed to one array, roles follow from that array alone. Arrays that can't be
    read are shown as far as their metadata goes."""
    names, name = store.array_names(), one_name(array, array_path)
    if name is not None:
        names = [selected(names, name)]
    metas: dict[str, ArrayMeta] = {}
    broken: dict[str, tuple[str, ...]] = {}
    for n in names:
        try:
            metas[n] = load_meta(store, n)
        except ZarrError:
            broken[n] = _as_it_is(store, n)
    aux = auxiliary(metas)
    bound = bounds(metas, aux)
    rows = [(m.name, compact(m.dims or ()), m.kind, compact(m.shape), compact(m.chunks if m.shape else ()), compact(m.attrs), role(m, aux, bound)) for m in metas.values()]
    return sorted([*rows, *broken.values()]) if broken else rows


def _as_it_is(store, name: str) -> tuple[str, ...]:  # noqa: ANN001
    """The row of an array that can't be parsed."""
    try:
        raw = json.loads(store.get(f"{name}/zarr.json") or store.get(f"{name}/.zarray") or b"{}")
    except ValueError:
        raw = {}
    raw = raw if isinstance(raw, dict) else {}
    kind = raw.get("data_type", raw.get("dtype", ""))
    return (name, compact(raw.get("dimension_names") or []), kind if isinstance(kind, str) else compact(kind), compact(raw.get("shape") or []), "[]", compact(raw.get("attributes") or {}), "data")


def group_rows(store) -> list[tuple[str, ...]]:  # noqa: ANN001
    """One row for each different dims, shape and chunks of data arrays; mismatches just make rows."""
    metas = load_all(store)
    found: dict[tuple, list[ArrayMeta]] = {}
    for m in data_arrays(metas):
        found.setdefault((dims_of(m), m.shape, m.chunks), []).append(m)
    rows = sorted(found.items(), key=lambda x: (x[0][0], x[0][1], [m.name for m in x[1]]))
    coords = lambda ms: [c.name for d in ms[0].dims if (c := coordinate(metas, ms[0], d))]
    return [(compact(d), compact(s), compact(c), compact([m.name for m in ms]), compact(coords(ms))) for (d, s, c), ms in rows]
