"""One row a cell: chunks decoded, masked, unpacked and laid out as Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from math import prod

import numpy as np
import pyarrow as pa

from ..plans.tables import Column, Table
from ..sources.arrays import ChunkCache, read_chunk, read_slice

#: Rows of a batch at most, so that a large chunk's rows never stand in memory at once.
BATCH_ROWS = 65_536
_WIDER = {"u1": np.int16, "u2": np.int32, "u4": np.int64}


def null_mask(raw: np.ndarray, null: object) -> np.ndarray | None:
    """Where the raw values are the NULL value, exactly; None if nowhere."""
    if null is None:
        return None
    if raw.dtype.kind == "f":
        mask = np.isnan(raw) if np.isnan(null) else raw.astype(np.float64) == null
    elif isinstance(null, int) and np.iinfo(raw.dtype).min <= null <= np.iinfo(raw.dtype).max:
        mask = raw == raw.dtype.type(null)
    else:
        return None
    return mask if mask.any() else None


def decoded(raw: np.ndarray, column: Column) -> pa.Array:
    """Raw values as the column's Arrow array: masked first, then scaled in doubles."""
    mask = null_mask(raw, column.null)
    if column.pack:
        return pa.array(raw.astype(np.float64) * column.pack[0] + column.pack[1], mask=mask)
    code = raw.dtype.str[1:]
    if code == "u8":
        return pa.array(raw, mask=mask).cast(pa.decimal128(20, 0))
    if code in _WIDER:
        raw = raw.astype(_WIDER[code])
    return pa.array(raw, mask=mask)


def chunk_batches(store, table: Table, columns: tuple[Column, ...], index: tuple[int, ...], cache: ChunkCache | None = None) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
    """The rows of one chunk, row-major over the part inside the array. Only the columns asked for
    are read: data chunks for data columns, slices of coordinates for coordinates, whose chunks a cache
    keeps for the next chunk."""
    clip = tuple(min(c, n - i * c) for i, c, n in zip(index, table.chunks, table.shape))
    total = prod(clip)
    sides: dict[int, pa.Array] = {}
    values: dict[str, np.ndarray] = {}
    for c in columns:
        if c.dim is None:
            values[c.name] = np.ascontiguousarray(read_chunk(store, c.meta, index)).reshape(-1)
        else:
            a = index[c.dim] * table.chunks[c.dim]
            z = a + clip[c.dim]
            sides[c.dim] = pa.array(np.arange(a, z, dtype=np.int64)) if c.meta is None else decoded(read_slice(store, c.meta, a, z, cache), c)
    steps = [prod(clip[d + 1 :]) for d in range(len(clip))]
    names = [c.name for c in columns]
    for a in range(0, total, BATCH_ROWS):
        row = np.arange(a, min(total, a + BATCH_ROWS))
        out = []
        for c in columns:
            if c.dim is None:
                out.append(decoded(values[c.name][a : a + BATCH_ROWS], c))
            else:
                out.append(sides[c.dim].take(pa.array(row // steps[c.dim] % clip[c.dim])))
        yield pa.RecordBatch.from_arrays(out, names=names)
