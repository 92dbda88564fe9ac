"""Removal of repeated and nearly repeated lines, by a segment-partition edit join.

Blank lines always stay. Two lines are linked if they are equal, whatever their length, or if both
have LEAST code points or more and are at most `edits` insertions, deletions and replacements apart. A line
goes if an earlier line is linked with it; earlier is by doc_id (null last), then by place.

Equal lines become one first. Of lines within k edits of each other, cut into k + 1 segments each,
one segment of the shorter occurs unchanged in the longer, near its place: which places depends on
the lengths alone. So every line is listed under its own segments, and looks under the substrings
that could equal a segment of a line as long or up to k shorter. Keys are hashes of substrings, made
for many lines at once from sums of powers. Where a substring is crowded, the strings left and right
of the match, each with the edits that remain for it, are cut again, and so on; at the end each line
looks for one earlier partner and stops. Keys still crowded after LEVELS cuts are dealt in blocks of
later and earlier lines to separate tasks. Candidates are verified by a bit-parallel edit distance
on a band of diagonals.

Null texts stay null and empty texts empty. Rows equal in doc_id and text count as one row. Lines
are known by a 64-bit hash. Texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common
from .anchors import _mix, _power
from .suffixes import _row_key

EDITS, LEAST = 2, 20
#: Under a substring with up to CROWD lines pairs are made; with up to MOST its lines look for one
#: earlier partner each, in one task; beyond that it is cut again, LEVELS times at most.
CROWD, MOST, LEVELS = 48, 1500, 8
#: Code points whose keys are made at a time; rows of sorted keys that a task holds, about.
LOT, HELD = 1 << 20, 50_000
Gap = tuple[int, int, int, int]  # start, end, edits left, length of the listed line's string there


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(text, seed=seed) - (1 << 63)


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is at most k: a band of 2k + 1 diagonals as bits of one number."""
    if abs(len(a) - len(b)) > k:
        return False
    start, end = 0, min(len(a), len(b))
    if a[:end] == b[:end]:
        start = end
    else:
        low, high = 0, end  # the common prefix by bisection
        while low < high:
            mid = (low + high + 1) // 2
            if a[:mid] == b[:mid]:
                low = mid
            else:
                high = mid - 1
        start = low
    a, b = a[start:], b[start:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[len(a) - mid :] == b[len(b) - mid :]:
            low = mid
        else:
            high = mid - 1
    a, b = a[: len(a) - low], b[: len(b) - low]
    if not a or not b:
        return max(len(a), len(b)) <= k
    # reach[e]: bit d is set if, with e edits, the row's prefix of a meets the prefix of b that is d - k longer
    full = (1 << (2 * k + 1)) - 1
    reach = [(((1 << (e + 1)) - 1) << k) & full for e in range(k + 1)]
    width = 2 * k + 1
    n = len(b)
    for i, c in enumerate(a):
        match = 0
        for d in range(width):
            j = i + d - k
            if 0 <= j < n and b[j] == c:
                match |= 1 << d
        new = []
        for e in range(k + 1):
            x = reach[e] & match
            if e:
                old = reach[e - 1]
                x |= old | (old >> 1) | (new[e - 1] << 1)
            new.append(x & full)
        if not new[k]:
            return False
        reach = new
    return bool(reach[k] >> (n - len(a) + k) & 1)


def cut(length: int, parts: int) -> list[tuple[int, int]]:
    """Segments as even as they can be, the shorter ones first: start, length."""
    short, longer = length // parts, length % parts
    out, at = [], 0
    for i in range(parts):
        size = short + (i >= parts - longer)
        out.append((at, size))
        at += size
    return out


def places(length: int, other: int, k: int) -> list[tuple[int, int, int]]:
    """Of a string of `length`: segment number, start and size of the substrings that could equal a
    segment of a string of length `other`. Multi-match-aware: with the first matching segment i
    from the left, at most i edits lie left of it, and from the right k - i."""
    more, out = length - other, []
    for i, (p, size) in enumerate(cut(other, k + 1)):
        low = max(p - i, p + more - (k - i), 0)
        high = min(p + i, p + more + (k - i), length - size)
        out += [(i, at, size) for at in range(low, high + 1)]
    return out


_KEYS = pa.schema([("key", pa.int64()), ("line", pa.int64()), ("own", pa.bool_())])
_WHERE = pa.schema([("line", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("at", pa.int64())])


def _lines(text: str) -> Iterator[tuple[int, str]]:
    for n, line in enumerate(text.split("\n")):
        if line and not line.isspace():
            yield n, line


def _lookups(n: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """`cut` and `places` for all lengths n at once: for each number of the segment and each place,
    which of the lines have it, length and segment start of the other line, its number, place, size."""
    for more in range(k + 1):
        other = n - more
        short, long = other // (k + 1), other % (k + 1)
        for i in range(k + 1):
            extra = i - (k + 1 - long)
            p, size = i * short + np.maximum(extra, 0), short + (extra >= 0)
            low = np.maximum(np.maximum(p - i, p + more - (k - i)), 0)
            high = np.minimum(np.minimum(p + i, p + more + (k - i)), n - size)
            for t in range(2 * k + 1):
                at = low + t
                rows = np.flatnonzero((at <= high) & (other >= LEAST))
                if not len(rows):
                    break
                yield rows, other[rows], p[rows], np.full(len(rows), i), at[rows], size[rows]


def _keys(lines: list[str], k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Keys of the lines: rows, key, own, and the other's length and segment start, the place, the
    size. An own key is both listed and looked under; others are looked under."""
    lengths = np.array([len(x) for x in lines], np.int64)
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    up, down = _power(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_mix((codes + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)) * up[: len(codes)], out=sums[1:])
    start = np.cumsum(lengths) - lengths
    for rows, other, p, i, at, size in _lookups(lengths, k):
        a = start[rows] + at
        h = _mix((sums[a + size] - sums[a]) * down[a])
        key = _mix(h + (other * 16 + i).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        yield rows, key, (other == lengths[rows]) & (at == p), other, p, i, at, size


def line_keys(line: str, k: int) -> Iterator[tuple[int, bool]]:
    """Keys a line is listed under (own) and looks under."""
    for _, key, own, *_ in _keys([line], k):
        yield int(key[0]), False
        if own[0]:
            yield int(key[0]), True


def _emit_keys(k: int):  # noqa: ANN202
    def emit(hashes: list[int], lines: list[str]) -> pa.RecordBatch:
        line = np.array(hashes, np.int64)
        found = [(key, line[rows], own) for rows, key, own, *_ in _keys(lines, k)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], schema=_KEYS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        hashes: list[int] = []
        lines: list[str] = []
        size = 0
        for b in batches:
            for text in common.texts(b.column(0)):
                for _, line in _lines(text):
                    if len(line) < LEAST:  # such lines link by equality alone, which needs no keys
                        continue
                    h = _hash(line)
                    if h in seen:
                        continue
                    if len(seen) > 400_000:
                        seen.clear()
                    seen.add(h)
                    hashes.append(h)
                    lines.append(line)
                    size += len(line)
                    if size >= LOT:
                        yield emit(hashes, lines)
                        hashes, lines, size = [], [], 0
        if lines:
            yield emit(hashes, lines)

    return run


def _where(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        line: list[int] = []
        docs: list[int | None] = []
        rows: list[int] = []
        at: list[int] = []
        for doc, text in zip(b.column(0).to_pylist(), common.texts(b.column(1))):
            own = list(_lines(text))
            if own:
                line += [_hash(x) for _, x in own]
                docs += [doc] * len(own)
                rows += [_row_key(doc, text.encode())] * len(own)
                at += [n for n, _ in own]
        yield common.batch(_WHERE, {"line": line, "doc_id": docs, "row": rows, "at": at})


#: Out of sorted keys: pairs of lines (key null), or lines of a crowded key (b null).
_MET = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("own", pa.bool_())])


def _meet(crowd_size: int, most_held: int):  # noqa: ANN202
    """Keys come sorted. A key under which one line alone is listed and looks has nothing. Of a key,
    most_held rows are held or so; with more it is crowded, and its rows pass on as they come."""
    def settle(key: np.ndarray, line: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([begin, [len(key)]]))
        listed = np.logical_or.reduceat(own, begin)
        two = begin[listed & (size == 2)]
        two = two[line[two] != line[two + 1]]
        pairs = [np.minimum(line[two], line[two + 1])], [np.maximum(line[two], line[two + 1])]
        hot: tuple[list, list, list] = ([], [], [])
        for a, n in zip(begin[listed & (size > 2)].tolist(), size[listed & (size > 2)].tolist()):
            everyone = np.unique(line[a : a + n])
            if len(everyone) < 2:
                continue
            mine = np.unique(line[a : a + n][own[a : a + n]])
            if len(everyone) <= crowd_size:
                x, y = np.repeat(mine, len(everyone)), np.tile(everyone, len(mine))
                differ = (x != y) & ((x < y) | ~np.isin(y, mine))
                pairs[0].append(np.minimum(x, y)[differ])
                pairs[1].append(np.maximum(x, y)[differ])
            else:
                hot[0].append(np.full(len(mine) + len(everyone), key[a]))
                hot[1].extend([mine, everyone])
                hot[2].extend([np.ones(len(mine), bool), np.zeros(len(everyone), bool)])
        a, b = (np.concatenate(x) for x in pairs)
        none = pa.nulls(len(a), pa.int64())
        crowded = _hot(*(np.concatenate(x) if x else np.empty(0, t) for x, t in zip(hot, (np.int64, np.int64, bool))))
        met = pa.RecordBatch.from_arrays([none, pa.array(a), pa.array(b), pa.array(np.zeros(len(a), bool))], schema=_MET)
        return pa.Table.from_batches([met, crowded]).combine_chunks().to_batches(max_chunksize=1 << 30)[0] if len(a) + len(crowded) else met

    def _hot(key: np.ndarray, line: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(line, pa.int64()), pa.nulls(len(key), pa.int64()), pa.array(own, pa.bool_())], schema=_MET)

    def passed(key: np.ndarray, line: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
        """Rows of a crowded key; those listed look too."""
        return _hot(np.concatenate([key, key[own]]), np.concatenate([line, line[own]]), np.concatenate([np.zeros(len(key), bool), np.ones(int(own.sum()), bool)]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        crowd: int | None = None
        for b in batches:
            rows = (b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False))
            if crowd is not None:
                stop = int(np.searchsorted(rows[0], crowd, "right"))
                if stop:
                    yield passed(*(x[:stop] for x in rows))
                    rows = tuple(x[stop:] for x in rows)
            if not len(rows[0]):
                continue
            crowd = None
            held.append(rows)
            if sum(len(x[0]) for x in held) >= most_held:
                key, line, own = (np.concatenate(x) for x in zip(*held))
                stop = int(np.searchsorted(key, key[-1]))
                if stop:
                    yield settle(key[:stop], line[:stop], own[:stop])
                    held = [(key[stop:], line[stop:], own[stop:])]
                else:
                    yield passed(key, line, own)
                    held, crowd = [], int(key[0])
        if held:
            yield settle(*(np.concatenate(x) for x in zip(*held)))

    return run


# --- crowded keys ---------------------------------------------------------------------------

_STATE = pa.schema([("key", pa.int64()), ("line", pa.int64()), ("own", pa.bool_()), ("gaps", pa.list_(pa.int64()))])
_SORTED_OUT = pa.schema([*_STATE, ("crowded", pa.bool_())])


def first_gaps(lines: list[str], keys: list[int], own: list[bool], k: int) -> list[list[list[Gap]]]:
    """For each line, how it can have come by the key: the strings beside the match and their edits."""
    found: list[list[list[Gap]]] = [[] for _ in lines]
    asked, listed = np.array(keys, np.int64), np.array(own, bool)
    for rows, key, mine, other, p, i, at, size in _keys(lines, k):
        for t in np.flatnonzero((key == asked[rows]) & (mine | ~listed[rows])):
            r, o, p_, i_, a, z = (int(x[t]) for x in (rows, other, p, i, at, size))
            found[r].append([(0, a, i_, p_), (a + z, len(lines[r]), k - i_, o - p_ - z)])
    return found


def finer(line: str, key: int, own: bool, gaps: list[Gap]) -> Iterator[tuple[int, list[Gap]]]:
    """One string beside the matches is cut again: the leftmost of those with most edits, alike for
    listed and looking lines. Strings without edits left must be equal and go into the key. A
    listed string as short as its edits asks no more of the other than its length allows."""
    mask = (1 << 64) - 1
    seed = key & mask
    for a, z, e, _ in gaps:
        if e == 0:
            seed = _hash(line[a:z], seed) & mask
    live = [g for g in gaps if g[2] > 0]
    if not live:
        yield seed - (1 << 63), []
        return
    index = max(range(len(live)), key=lambda i: (live[i][2], -i))
    a, z, e, other = live[index]
    left, right, n = live[:index], live[index + 1 :], z - a
    if abs(n - other) > e:
        return
    if other <= e:
        yield _hash(f"{other}", (seed + index) & mask), [*left, *right]
        return
    segments = cut(other, e + 1)
    for i, at, size in [(i, p, size) for i, (p, size) in enumerate(segments)] if own else places(n, other, e):
        p = segments[i][0]
        yield _hash(line[a + at : a + at + size], (seed + other * 64 + i * 8 + index) & mask), [*left, (a, a + at, i, p), (a + at + size, z, e - i, other - p - size), *right]


def _refine(first: bool, k: int):  # noqa: ANN202
    """Rows of state beside their lines' text (packed): the rows under finer keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for b in batches:
            rows: dict = {}
            given = b.to_pylist()
            lines = [press.decompress(x["packed"], max_output_size=1 << 30).decode() for x in given]
            if first:
                starts = first_gaps(lines, [x["key"] for x in given], [x["own"] for x in given], k) if lines else []
            else:
                starts = [[[tuple(x["gaps"][i : i + 4]) for i in range(0, len(x["gaps"] or []), 4)]] for x in given]
            for x, line, start in zip(given, lines, starts):
                for gaps in start:
                    for key, left in finer(line, x["key"], x["own"], gaps):
                        rows[key, x["line"], x["own"], tuple(left)] = None
            yield common.batch(_STATE, {"key": [r[0] for r in rows], "line": [r[1] for r in rows], "own": [r[2] for r in rows], "gaps": [[v for g in r[3] for v in g] for r in rows]})

    return run


def _classified(most: int):  # noqa: ANN202
    """Rows sorted by key: those of keys under which lines can meet, and whether they are crowded.
    Of a key, `most` lines are held at most; once there are more its rows pass on as they come."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        lines: set[int] = set()
        key, crowded = None, False

        def settle() -> list[tuple]:
            if crowded or len(lines) < 2 or not any(r[2] for r in held) or all(r[2] for r in held):
                return []
            return [(*r, False) for r in dict.fromkeys(held)]

        for b in batches:
            out: list[tuple] = []
            for k, line, own, gaps in zip(*(c.to_pylist() for c in b.columns)):
                if k != key:
                    out += settle()
                    held, lines, key, crowded = [], set(), k, False
                row = (k, line, own, tuple(gaps))
                if crowded:
                    out.append((*row, True))
                    continue
                held.append(row)
                lines.add(line)
                if len(lines) > most:
                    crowded = True
                    out += [(*r, True) for r in dict.fromkeys(held)]
                    held = []
            yield common.batch(_SORTED_OUT, {f.name: [list(r[i]) if i == 3 else r[i] for r in out] for i, f in enumerate(_SORTED_OUT)})
        out = settle()
        if out:
            yield common.batch(_SORTED_OUT, {f.name: [list(r[i]) if i == 3 else r[i] for r in out] for i, f in enumerate(_SORTED_OUT)})

    return run


def _order(x: dict) -> tuple:
    return (x["doc_id"] is None, x["doc_id"] or 0, x["row"], x["at"])


def _verify_keys(k: int):  # noqa: ANN202
    """Rows sorted by key, i, j (blocks of later and earlier lines): lines that have an earlier partner."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        members: list[dict] = []

        def settle() -> list[int]:
            ranked = sorted(members, key=_order)
            texts = [press.decompress(y["packed"], max_output_size=1 << 30).decode() for y in ranked]
            gone = []
            for i, y in enumerate(ranked):
                if not y["late"]:
                    continue
                for j in range(i):
                    x = ranked[j]
                    if x["early"] and x["line"] != y["line"] and (y["own"] and x["looks"] or y["looks"] and x["own"]) and within(texts[i], texts[j], k):
                        gone.append(y["line"])
                        break
            return gone

        for b in batches:
            gone: list[int] = []
            for x in b.to_pylist():
                if members and any(members[-1][c] != x[c] for c in ("key", "i", "j")):
                    gone += settle()
                    members = []
                members.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(gone, pa.int64())], names=["line"])
        if members:
            yield pa.RecordBatch.from_arrays([pa.array(settle(), pa.int64())], names=["line"])

    return run


def _crowded(hot: DataFrame, lines: DataFrame, k: int) -> DataFrame:
    """line: those of crowded keys that have an earlier partner. lines: line, doc_id, row, at, packed.
    The rows of a level are keys and places alone; texts join them for the next cut."""
    texts = lines.select("line", "packed")
    fine, done = hot.withColumn("gaps", F.array().cast("array<bigint>")).select(*_STATE.names), []
    blocks = F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(True).alias("late"), F.lit(True).alias("early")))
    sided = lambda df: df.groupBy("key", "line").agg(F.max("own").alias("own"), F.max(~F.col("own")).alias("looks"))
    for level in range(LEVELS + 1):
        told = common.written(fine.repartition("key").sortWithinPartitions("key", "line").mapInArrow(_classified(MOST), common.ddl(_SORTED_OUT)))
        done.append(sided(told.where("not crowded")).withColumn("_b", blocks))
        state = told.where("crowded").select(*_STATE.names)
        if state.isEmpty():
            break
        if level == LEVELS:  # what eight cuts leave together: every block of later lines meets every block of earlier ones
            left = common.checkpointed(sided(state))
            many = left.groupBy("key").agg(F.ceil(F.count("*") / MOST).alias("nb"))
            each = F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)
            mine = F.pmod(F.xxhash64("line"), "nb")
            place = lambda i, j, late: F.struct(i.alias("i"), j.alias("j"), F.lit(late).alias("late"), F.lit(not late).alias("early"))
            spread = F.concat(F.transform(each, lambda j: place(mine, j, True)), F.transform(each, lambda i: place(i, mine, False)))
            done.append(left.join(many, "key").withColumn("_b", spread).select("key", "line", "own", "looks", "_b"))
            break
        fine = state.join(texts, "line").select(*_STATE.names, "packed").mapInArrow(_refine(level == 0, k), common.ddl(_STATE))
    whole = done[0]
    for x in done[1:]:
        whole = whole.unionByName(x)
    beside = whole.withColumn("_b", F.explode("_b")).join(lines, "line").select("key", "_b.i", "_b.j", "_b.late", "_b.early", "line", "own", "looks", "doc_id", "row", "at", "packed")
    return beside.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_verify_keys(k), "line bigint")


_PACKED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("packed", pa.binary())])
_FULL = pa.schema([("line", pa.int64()), ("packed", pa.binary())])


def _packed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            ids, data = b.column(0).to_pylist(), [t.encode() for t in common.texts(b.column(1))]
            yield common.batch(_PACKED, {"row": [_row_key(d, x) for d, x in zip(ids, data)], "doc_id": ids, "packed": [press(x) for x in data]})

    return docs.select("doc_id", "text").mapInArrow(run, common.ddl(_PACKED))


def _fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shrink, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        out: tuple[list, list] = ([], [])
        for packed, asked in zip(b.column(0), b.column(1).to_pylist()):
            lines = shrink.decompress(packed.as_py(), max_output_size=1 << 31).decode().split("\n")
            for x in asked:
                out[0].append(x["line"])
                out[1].append(press(lines[x["at"]].encode()))
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], schema=_FULL)


def _linked(k: int):  # noqa: ANN202
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for b in batches:
            later = []
            for x in b.to_pylist():
                a, z = (press.decompress(x[c], max_output_size=1 << 30).decode() for c in ("_pa", "_pb"))
                if within(a, z, k):
                    later.append(x["late"])
            yield pa.RecordBatch.from_arrays([pa.array(later, pa.int64())], names=["line"])

    return run


def drops(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """row, at (number of a line of the row, from 0), near (whether for want of equality) of all
    lines that go. docs: doc_id, text."""
    common.ready(docs.sparkSession)
    where = common.written(docs.mapInArrow(_where, common.ddl(_WHERE)))
    rank = F.struct(F.col("doc_id").isNull().alias("o"), F.col("doc_id"), F.col("row"), F.col("at"))
    firsts = common.written(where.groupBy("line").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).select("line", "first", (F.col("first") != F.col("last")).alias("many")))
    keys = docs.select("text").mapInArrow(_emit_keys(edits), common.ddl(_KEYS)).repartition("key").sortWithinPartitions("key")
    met = common.written(keys.mapInArrow(_meet(CROWD, HELD), common.ddl(_MET)))
    pairs = met.where("key is null").select("a", "b").distinct()
    hot = met.where("key is not null").select("key", F.col("a").alias("line"), "own").distinct()
    involved = met.select(F.explode(F.array("a", "b")).alias("line")).where("line is not null").distinct()
    wanted = firsts.join(involved, "line", "left_semi").select("line", "first.*")
    asked = wanted.groupBy("row").agg(F.collect_set(F.struct("line", "at")).alias("asked"))
    text = _packed(docs).join(asked, "row").select("packed", "asked").mapInArrow(_fetch, common.ddl(_FULL)).groupBy("line").agg(F.first("packed").alias("packed"))
    known = common.checkpointed(wanted.join(text, "line").select("line", "doc_id", "row", "at", "packed"))
    side = lambda c: known.select(F.col("line").alias(c), F.struct(F.col("doc_id").isNull().alias("o"), "doc_id", "row", "at").alias(f"_r{c}"), F.col("packed").alias(f"_p{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select(F.when(F.col("_ra") < F.col("_rb"), F.col("b")).otherwise(F.col("a")).alias("late"), "_pa", "_pb")
    near = both.mapInArrow(_linked(edits), "line bigint")
    if not hot.isEmpty():
        near = near.unionByName(_crowded(hot, known, edits))
    near = near.distinct().withColumn("near", F.lit(True))
    # written, so that the join below deals both sides anew and a skew join can split a common line
    verdict = common.written(firsts.join(near, "line", "left").where("many or near").select("line", "first", F.coalesce("near", F.lit(False)).alias("near")))
    here = F.struct(F.col("doc_id").isNull().alias("o"), F.col("doc_id"), F.col("row"), F.col("at"))
    return where.join(verdict, "line").withColumn("lead", here == F.col("first")).where("near or not lead").select("row", "at", (F.col("near") & F.col("lead")).alias("near"))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_equal", pa.int64()), ("n_near", pa.int64()), ("kept_sha256", pa.string())])


def _joined(docs: DataFrame, edits: int) -> DataFrame:
    gone = drops(docs.select("doc_id", "text"), edits).distinct().groupBy("row").agg(F.collect_list(F.struct("at", "near")).alias("gone"))
    return _packed(docs).join(gone, "row", "left")


def _without(data: bytes, gone: list[dict] | None) -> tuple[str, int]:
    lines = data.decode().split("\n")
    out = {x["at"] for x in gone or ()}
    return "\n".join(line for n, line in enumerate(lines) if n not in out), len(lines)


def line_dedup_digests(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """doc_id, n_lines, n_equal, n_near (lines that went), kept_sha256 of the remaining text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for b in batches:
            out: dict = {f.name: [] for f in _OUT}
            out["doc_id"] = b.column(0).to_pylist()
            for packed, gone in zip(b.column(1), b.column(2).to_pylist()):
                text, n = _without(press.decompress(packed.as_py(), max_output_size=1 << 31), gone)
                near = sum(x["near"] for x in gone or ())
                for name, value in zip(_OUT.names[1:], (n, len(gone or ()) - near, near, hashlib.sha256(text.encode()).hexdigest())):
                    out[name].append(value)
            yield common.batch(_OUT, out)

    return _joined(common.need(docs, "doc_id", "text"), edits).select("doc_id", "packed", "gone").mapInArrow(run, common.ddl(_OUT))


def line_dedup(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """docs without the lines that go, n_chars (if there is such a column) to match. A document
    that is left without a word, and had one, goes as a whole. The text moves once, compressed;
    the other columns move beside the line numbers."""
    names = docs.columns
    common.ready(docs.sparkSession)

    def key(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts_ = b.column("doc_id").to_pylist(), common.texts(b.column("text"))
            rows = pa.array([_row_key(d, t.encode()) for d, t in zip(ids, texts_)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, rows], names=[*b.schema.names, "_row"])

    schema = StructType([*docs.schema.fields, StructField("_row", LongType())])
    gone = drops(docs.select("doc_id", "text"), edits).distinct().groupBy("row").agg(F.collect_list("at").alias("_gone")).withColumnRenamed("row", "_row")
    whole = docs.mapInArrow(key, schema).join(gone, "_row", "left")
    lines = F.transform(F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(x.alias("x"), i.cast("long").alias("i"))), lambda s: ~F.array_contains("_gone", s["i"])), lambda s: s["x"])
    text = F.when(F.col("_gone").isNotNull(), F.array_join(lines, "\n")).otherwise(F.col("text"))
    out = whole.withColumn("_new", text).where("_gone is null or _new rlike '[^ \\\\t-\\\\r]'").withColumn("text", F.col("_new"))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("_gone").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[f"`{n}`" for n in names])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_digests(common.table(spark, sf_dir, "documents"))
