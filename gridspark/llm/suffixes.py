"""Removal of repeated byte strings by a difference-cover suffix array.

A byte goes if a string of 200 bytes that covers it starts anywhere else too. Three steps:

1. What can't repeat is left out. Each window of 200 bytes picks an anchor by its content, and the
   windows of one anchor form a context. A context whose anchor occurs nowhere else repeats
   nothing. Contexts that are equal in full repeat wholly, and one stands for all of them.
2. The different contexts of a shared anchor are suffix-sorted by the difference-cover algorithm
   modulo 3 (triples of the sampled suffixes, recursion on their names, merge of the rest), in
   blocks that hold all contexts of an anchor. Windows whose 200 bytes equal those of their
   neighbour in suffix order repeat. Anchors with more contexts than a block takes are told apart
   by longer strings around them first, until they fit.
3. Runs of repeated windows come back to their documents, which drop the bytes.

Anchors that hold over a thousandth of all rows are dealt by anchor and context instead of by
anchor, there are fewer than a thousand of them; copies within a task are combined before the
shuffle. Texts move twice, compressed, to meet what was found about them.

Null and empty texts lose nothing. Rows are told apart by doc_id and text; repeated rows repeat
each other, so each loses all its bytes from 200 on. Matches never cross rows. Texts of any length
are treated whole, in blocks.
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

from . import common
from .anchors import GRAM, WIDTH, contexts

#: Bytes of contexts that are suffix-sorted at a time, and the largest group that a block takes.
BLOCK_BYTES = 1_500_000
#: Rows of anchors that a task combines before it passes them on.
COMBINE_ROWS = 1_500_000
#: An anchor is dealt by context too if it has this share of all rows, and this many at least.
HOT_SHARE, HOT_ROWS = 1000, 4000
_U64 = np.uint64


def suffix_array(s: np.ndarray, top: int) -> np.ndarray:
    """Suffixes of the positive integers s (at most top) in order, by difference cover modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    s = np.concatenate([s.astype(np.int64), np.zeros(3, np.int64)])
    n1, extra = (n + 1) // 3, n % 3 == 1  # with n % 3 == 1 an empty suffix joins the sample
    one = np.arange(1, n + extra, 3)
    two = np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    base = top + 1
    if base < (1 << 20) * 2:
        key = (s[sample] * base + s[sample + 1]) * base + s[sample + 2]
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    else:
        order = np.lexsort((s[sample + 2], s[sample + 1], s[sample]))
        t = sample[order]
        fresh = np.ones(len(t), bool)
        fresh[1:] = (s[t[1:]] != s[t[:-1]]) | (s[t[1:] + 1] != s[t[:-1] + 1]) | (s[t[1:] + 2] != s[t[:-1] + 2])
    names = np.cumsum(fresh)
    if names[-1] < len(sample):
        named = np.empty(len(sample), np.int64)
        named[order] = names
        order = suffix_array(named, int(names[-1]))
    sorted_sample = sample[order]
    rank = np.zeros(n + 4, np.int64)
    rank[sorted_sample] = np.arange(1, len(sample) + 1)
    sorted_sample = sorted_sample[sorted_sample < n]
    rest = np.arange(0, n, 3)
    wide = len(sample) + 2
    key = s[rest] * wide + rank[rest + 1]
    rest = rest[np.argsort(key, kind="stable")]
    # the merge: how many sampled suffixes of either kind come before each of the rest
    key = s[rest] * wide + rank[rest + 1]
    ones = sorted_sample[sorted_sample % 3 == 1]
    twos = sorted_sample[sorted_sample % 3 == 2]
    before = np.searchsorted(s[ones] * wide + rank[ones + 1], key)
    # two symbols and a rank: the pair of symbols is named by its place among all pairs
    pairs, pair = np.unique(np.concatenate([s[twos] * base + s[twos + 1], s[rest] * base + s[rest + 1]]), return_inverse=True)
    before = before + np.searchsorted(pair[: len(twos)] * wide + rank[twos + 2], pair[len(twos) :] * wide + rank[rest + 2])
    out = np.empty(n, np.int64)
    at = before + np.arange(len(rest))
    out[at] = rest
    left = np.ones(n, bool)
    left[at] = False
    out[left] = sorted_sample
    return out


def repeated_windows(strings: list[bytes], windows: list[int], width: int = WIDTH) -> list[np.ndarray]:
    """For each string, which of its first `windows` windows of `width` bytes start elsewhere too."""
    lengths = np.array([len(x) for x in strings])
    start = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    n = int(lengths.sum()) + len(strings)
    raw = np.zeros(n + 8, np.uint8)
    s = np.empty(n, np.int64)
    for i, (x, a) in enumerate(zip(strings, start)):
        raw[a : a + len(x)] = np.frombuffer(x, np.uint8)
    s[:] = raw[:n].astype(np.int64) + 1
    s[start + lengths] = 257 + np.arange(len(strings))  # ends differ, so nothing runs over them
    valid = np.zeros(n, bool)
    for a, k in zip(start, windows):
        valid[a : a + k] = True
    order = suffix_array(s, 257 + len(strings))
    order = order[valid[order]]
    word = np.lib.stride_tricks.sliding_window_view(raw, 8)[:n].copy().view(np.uint64).reshape(-1)
    steps = [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]
    same = np.arange(len(order) - 1)
    for k in steps:
        same = same[word[order[same] + k] == word[order[same + 1] + k]]
    twice = np.zeros(n, bool)
    twice[order[same]] = True
    twice[order[same + 1]] = True
    return [twice[a : a + k] for a, k in zip(start, windows)]


def _runs(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of True."""
    edge = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _row_key(doc: int | None, data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data, seed=0 if doc is None else (doc * 2 + 1) & ((1 << 64) - 1)) - (1 << 63)


# kind 0: a context; kind 1: a run of windows known to repeat
_FOUND = pa.schema([("kind", pa.int32()), ("route", pa.int64()), ("gram", pa.int64()), ("context", pa.int64()), ("row", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("place", pa.int64()), ("multi", pa.bool_())])


def _combined(gram, context, row, first, last, place, hot) -> pa.RecordBatch:  # noqa: ANN001
    """A task's contexts: those that are equal become runs to remove and one that stands for them."""
    order = np.lexsort((context, gram))
    g, c = gram[order], context[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])])
    count = np.diff(np.concatenate([np.flatnonzero(new), [len(g)]]))
    lead = order[new]
    many = np.zeros(len(g), bool)
    many[order] = np.repeat(count > 1, count)
    where = np.flatnonzero(many)
    # runs of neighbouring contexts of a row become one
    if len(where):
        split = np.concatenate([[True], (row[where[1:]] != row[where[:-1]]) | (first[where[1:]] != last[where[:-1]] + 1)])
        head = where[split]
        tail = where[np.concatenate([np.flatnonzero(split)[1:] - 1, [len(where) - 1]])]
    else:
        head = tail = where
    k, m = len(lead), len(head)
    # a hot anchor's contexts are dealt apart
    spread = np.where(np.isin(gram[lead], hot), context[lead], gram[lead]) if len(hot) else gram[lead]
    zero = np.zeros(m, np.int64)
    cols = [
        np.concatenate([np.zeros(k, np.int32), np.ones(m, np.int32)]), np.concatenate([spread.view(np.int64), row[head]]), np.concatenate([gram[lead].view(np.int64), zero]), np.concatenate([context[lead].view(np.int64), zero]),
        np.concatenate([row[lead], row[head]]), np.concatenate([first[lead], first[head]]), np.concatenate([last[lead], last[tail]]), np.concatenate([place[lead], zero]), np.concatenate([count > 1, np.ones(m, bool)]),
    ]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, _FOUND)], schema=_FOUND)


def _gathered(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """gram, context, row, first, last, place of the texts of a task, in lots."""
    lot: list[tuple[np.ndarray, ...]] = []
    size = 0
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), common.texts(b.column(1))):
            data = text.encode()
            if len(data) < WIDTH:
                continue
            g, c, first, last, place = contexts(data)
            lot.append((g, c, np.full(len(g), _row_key(doc, data)), first, last, place))
            size += len(g)
            if size >= most:
                yield tuple(np.concatenate(x) for x in zip(*lot))
                lot, size = [], 0
    if lot:
        yield tuple(np.concatenate(x) for x in zip(*lot))


def hot_anchors(docs: DataFrame) -> np.ndarray:
    """Anchors with over a thousandth of all rows (so under a thousand), after each task has
    combined its own. A task names those of its own rows; what it leaves out is less than a
    thousandth of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, c, *_ in _gathered(batches, COMBINE_ROWS):
            order = np.lexsort((c, g))
            g, c = g[order], c[order]
            g = g[np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])])]
            values, counts = np.unique(g, return_counts=True)
            big = counts * HOT_SHARE >= len(g)
            yield pa.RecordBatch.from_arrays([pa.array([None, *values[big].view(np.int64).tolist()], pa.int64()), pa.array([len(g), *counts[big].tolist()], pa.int64())], names=["gram", "n"])

    counted = docs.mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    counted = common.checkpointed(counted)
    total = counted.where("gram is null").first()
    least = max(HOT_ROWS, (total[1] if total else 0) // HOT_SHARE + 1)
    return np.array([r[0] for r in counted.where(f"gram is not null and n >= {least}").collect()], np.int64).view(np.uint64)


def _shared(batches: Iterable[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Over contexts sorted by anchor and context: runs to remove (kind 1), and one context of each
    sort (kind 0) where an anchor has several sorts."""
    held: pa.Table | None = None

    def settle(t: pa.Table, whole: bool, known: int | None) -> tuple[pa.RecordBatch, pa.Table | None, int | None]:
        """What can be told of t; unless whole, its last sort of context waits for more rows."""
        g, c = t["gram"].to_numpy(), t["context"].to_numpy()
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])])
        begin = np.flatnonzero(new)
        count = np.diff(np.concatenate([begin, [len(g)]]))
        group = g[begin]
        several = np.zeros(len(begin), bool)
        several[1:] |= group[1:] == group[:-1]
        several[:-1] |= group[:-1] == group[1:]
        if known is not None:
            several |= group == known
        if len(hot):
            several |= np.isin(group, hot)
        done = len(begin)
        rest = None
        if not whole:
            # the last anchor waits whole while it is small; a large one, known to be shared, but for its last sort
            first_of_last = int(np.flatnonzero(group == group[-1])[0])
            large = len(g) - begin[first_of_last] > 200_000 and several[-1]
            done = len(begin) - 1 if large else first_of_last
            rest = t.slice(begin[done]) if done < len(begin) else None
            known = int(group[-1]) if large else known if known is not None and group[-1] == known else None
        end = begin[done] if done < len(begin) else len(g)
        multi = t["multi"].to_numpy(zero_copy_only=False)
        many = np.repeat(count > 1, count)[:end]
        lead = begin[:done][several[:done]]
        flag = (count[:done][several[:done]] > 1) | multi[lead]
        pick = np.concatenate([np.flatnonzero(many), lead])
        kinds = np.concatenate([np.ones(int(many.sum()), np.int32), np.zeros(len(lead), np.int32)])
        columns = {f.name: t[f.name].to_numpy(zero_copy_only=False)[pick] for f in _FOUND}
        columns |= {"kind": kinds, "multi": np.concatenate([np.ones(int(many.sum()), bool), flag])}
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in _FOUND], schema=_FOUND), rest, known

    known: int | None = None
    for b in batches:
        mark = np.asarray(b.column(0).to_numpy() == 1)
        if mark.any():
            yield b.filter(pa.array(mark))
        own = pa.Table.from_batches([b.filter(pa.array(~mark))])
        if not len(own):
            continue
        held = own if held is None else pa.concat_tables([held, own])
        if len(held) > 100_000:
            out, held, known = settle(held.combine_chunks(), False, known)
            if len(out):
                yield out
    if held is not None and len(held):
        out, _, _ = settle(held.combine_chunks(), True, known)
        yield out


_TEXT = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("packed", pa.binary())])
_CONTEXT = pa.schema([("gram", pa.int64()), ("row", pa.int64()), ("first", pa.int64()), ("windows", pa.int64()), ("at", pa.int64()), ("reach", pa.int64()), ("multi", pa.bool_()), ("data", pa.binary())])
_RUNS = "row bigint, first bigint, last bigint"


def _packed(docs: DataFrame) -> DataFrame:
    """row, doc_id and the compressed bytes of every document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            data = [t.encode() for t in common.texts(b.column(1))]
            docs_ = b.column(0).to_pylist()
            yield common.batch(_TEXT, {"row": [_row_key(d, x) for d, x in zip(docs_, data)], "doc_id": docs_, "packed": [press(x) for x in data]})

    return docs.mapInArrow(run, common.ddl(_TEXT))


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts' bytes out of their texts; an anchor's string reaches GRAM bytes from `at`."""
    for b in batches:
        out: dict = {f.name: [] for f in _CONTEXT}
        press = zstandard.ZstdDecompressor()
        for packed, asked in zip(b.column(0), b.column(1)):
            data = press.decompress(packed.as_py(), max_output_size=1 << 31)
            for x in asked.as_py():
                a, z = x["first"], x["last"]
                for name, value in (("gram", x["gram"]), ("row", x["row"]), ("first", a), ("windows", z - a + 1), ("at", x["place"] - a), ("reach", GRAM), ("multi", x["multi"]), ("data", data[a : z + WIDTH])):
                    out[name].append(value)
        yield common.batch(_CONTEXT, out)


def _sorted_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix-sorts contexts that come ordered by anchor, in blocks cut between anchors."""
    rows: list[tuple] = []
    size, edge = 0, 0

    def solve(some: list[tuple]) -> pa.RecordBatch:
        found = repeated_windows([x[5] for x in some], [x[3] for x in some])
        out: tuple[list, list, list] = ([], [], [])
        for (_, row, first, _, multi, _), on in zip(some, found):
            if not multi and on.any():
                a, z = _runs(on)
                out[0].extend([row] * len(a))
                out[1].extend((a + first).tolist())
                out[2].extend((z + first).tolist())
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["row", "first", "last"])

    for b in batches:
        for x in zip(*(b.column(k).to_pylist() for k in ("gram", "row", "first", "windows", "multi", "data"))):
            if rows and x[0] != rows[-1][0]:
                edge = len(rows)
                if size >= BLOCK_BYTES:
                    yield solve(rows)
                    rows, size, edge = [], 0, 0
            rows.append(x)
            size += len(x[5])
            if size > 2 * BLOCK_BYTES and edge:
                yield solve(rows[:edge])
                rows, edge = rows[edge:], 0
                size = sum(len(y[5]) for y in rows)
    if rows:
        yield solve(rows)


def _split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of a crowded anchor in two parts, by longer strings around it.

    Windows that take in `half` more bytes on the left of the anchor's string form one part, with
    that longer string as their anchor; the others take in as much on the right, for a window is
    longer than both. Equal windows fall in parts of equal strings."""
    for b in batches:
        out: dict = {f.name: [] for f in _CONTEXT}
        for gram, row, first, windows, at, reach, multi, data in zip(*(c.to_pylist() for c in b.columns)):
            half = max(1, (WIDTH - reach) // 2)
            left = max(0, min(windows, at - half + 1))  # windows that start at or before at - half
            for k, (a, z) in enumerate(((0, left), (left, windows))):
                if a >= z:
                    continue
                start, length = (at - half, reach + half) if k == 0 else (at, reach + half)
                piece = data[start : start + length]
                key = xxhash.xxh3_64_intdigest(piece, seed=2 * length + k) ^ (gram & ((1 << 64) - 1))
                for name, value in (("gram", key - (1 << 63)), ("row", row), ("first", first + a), ("windows", z - a), ("at", start - a), ("reach", length), ("multi", multi), ("data", data[a : z - 1 + WIDTH])):
                    out[name].append(value)
        yield common.batch(_CONTEXT, out)


def _relieved(found: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Contexts of which no anchor has more than a block takes, and runs met on the way."""
    ready, runs = [], []
    for _ in range(12):
        crowd = common.checkpointed(found.groupBy("gram").agg(F.sum(F.length("data")).alias("n")).where(f"n > {BLOCK_BYTES}").select("gram"))
        if crowd.isEmpty():
            break
        ready.append(found.join(crowd, "gram", "left_anti"))
        part = common.checkpointed(found.join(crowd, "gram", "left_semi").select(*_CONTEXT.names).mapInArrow(_split, common.ddl(_CONTEXT)).withColumn("sort", F.xxhash64("data")))
        sorts = part.groupBy("gram", "sort").agg(F.count("*").alias("n"), F.max("multi").alias("any"), F.min(F.struct("row", "first")).alias("lead"))
        told = part.join(sorts, ["gram", "sort"])
        runs.append(told.where("n > 1 and not multi").select("row", "first", (F.col("first") + F.col("windows") - 1).alias("last")))
        several = sorts.groupBy("gram").agg(F.count("*").alias("sorts")).where("sorts > 1").select("gram")
        kept = told.where("row = lead.row and first = lead.first").withColumn("multi", F.col("any") | (F.col("n") > 1)).join(several, "gram", "left_semi")
        found = common.checkpointed(kept.select(*_CONTEXT.names))
    ready.append(found)
    whole = ready[0]
    for x in ready[1:]:
        whole = whole.unionByName(x)
    return whole, runs


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
_KEPT = pa.schema([*list(_OUT)[:4], ("kept", pa.binary())])


def repeated_runs(docs: DataFrame) -> DataFrame:
    """row, first, last: windows first to last of the row repeat. docs: doc_id, text."""
    spark = common.ready(docs.sparkSession)
    hot = hot_anchors(docs)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _gathered(batches, COMBINE_ROWS):
            whole = _combined(*lot, hot)
            for at in range(0, len(whole), 50_000):
                yield whole.slice(at, 50_000)

    order = hot.view(np.int64)
    dealt = docs.mapInArrow(find, common.ddl(_FOUND)).repartition("route").sortWithinPartitions("gram", "context")
    told = common.written(dealt.mapInArrow(lambda b: _shared(b, order), common.ddl(_FOUND)))
    asked = told.where("kind = 0").groupBy("row").agg(F.collect_list(F.struct("gram", "row", "first", "last", "place", "multi")).alias("asked"))
    cut = _packed(docs).join(asked, "row").select("packed", "asked").mapInArrow(_cut, common.ddl(_CONTEXT))
    found, runs = _relieved(common.written(cut))
    last = found.select("gram", "row", "first", "windows", "multi", "data").repartition("gram").sortWithinPartitions("gram").mapInArrow(_sorted_blocks, _RUNS)
    out = told.where("kind = 1").select("row", "first", "last").unionByName(last)
    for r in runs:
        out = out.unionByName(r)
    return out


def remove_repeats(docs: DataFrame, digests: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes; their SHA-256 with digests)."""
    docs = common.need(docs, "doc_id", "text")
    runs = repeated_runs(docs).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    schema = _OUT if digests else _KEPT

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for b in batches:
            out: dict = {f.name: [] for f in schema}
            out["doc_id"] = b.column(0).to_pylist()
            for packed, marks in zip(b.column(1), b.column(2).to_pylist()):
                data = press.decompress(packed.as_py(), max_output_size=1 << 31)
                kept, done, spans, removed = [], 0, 0, 0
                end = 0  # of the removed run so far
                for a, z in sorted((m["first"], m["last"] + WIDTH) for m in marks or ()):
                    if spans == 0 or a > end:
                        kept.append(data[done:a])
                        spans += 1
                        removed += z - a
                        end = z
                    elif z > end:
                        removed += z - end
                        end = z
                    done = end
                rest = b"".join([*kept, data[done:]])
                for name, value in (("n_bytes", len(data)), ("n_removed", removed), ("n_spans", spans), (schema.names[4], hashlib.sha256(rest).hexdigest() if digests else rest)):
                    out[name].append(value)
            yield common.batch(schema, out)

    return _packed(docs).join(runs, "row", "left").select("doc_id", "packed", "runs").mapInArrow(run, common.ddl(schema))


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents"), digests=True)
