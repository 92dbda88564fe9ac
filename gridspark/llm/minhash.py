"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document's set holds the distinct shingles of `words` words, as 64-bit hashes. Two permutations
of the 32-bit integers make all signature coordinates: the first breaks up structure, the second
is shifted circularly by k for coordinate k. Bands of ROWS coordinates give candidates: at a
similarity of 0.8 all BANDS miss with probability 1e-5; at 0.4, as texts around one common passage
have, a pair meets with probability 0.02.

Rows of equal sets form a class first, so that copies, however many, are one member from then on.
In each bucket the members are compared with one centre, the member of the least hash, so that
buckets of like members tend to have the same. Members then still apart from most of their bucket
are held against the rest of it, in blocks of bounded size that different tasks take. There a pair is told by its whole signature (two bits of each
coordinate) and goes on, once, if the estimate is less than DOUBT deviations under the threshold;
at the threshold itself that misses one in 100,000 more. Links already implied by the components
so far are never made. A link counts once the full sets confirm it.

Null or empty texts have an empty set and are linked with nothing. Rows with a null doc_id are
linked with nothing either, and have no component. Rows of one doc_id are one document: their
sets are compared each, and their classes belong together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph

BANDS, ROWS = 80, 9
#: Members of a block; standard deviations that an estimate may lie under the threshold.
BLOCK, DOUBT = 512, 4.3
_SHIFTS = np.arange(BANDS * ROWS, dtype=np.uint32)
_U64 = np.uint64


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def _permute(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A permutation of the 32-bit integers, in place: two odd multipliers and a xor-shift. Least
    values are taken of it, so the high bits are what must be well mixed."""
    x *= np.uint32(first)
    x ^= x >> np.uint32(15)
    x *= np.uint32(second)
    return x


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes. Only A-Z are lower-cased; bytes.split() cuts at the six
    ASCII white-space characters. Fewer words than `words` make one shingle of all."""
    found = text.encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    size = min(words, len(found))
    out = np.full(len(h) - size + 1, _U64(size))
    for k in range(size):
        out = _mix64(out * _U64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k])
    return np.unique(out)


def signature(found: np.ndarray, block: int = 128) -> np.ndarray:
    """Coordinate k: the least of the second permutation, shifted by k, over the first's values."""
    start = (found ^ (found >> _U64(32))).astype(np.uint32)
    start ^= start >> np.uint32(16)
    start = _permute(start, 0x85EBCA6B, 0xC2B2AE35)
    start ^= start >> np.uint32(16)
    least = np.full(len(_SHIFTS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(start), block):
        values = _permute(start[at : at + block, None] + _SHIFTS[None], 0xCC9E2D51, 0x1B873593)
        np.minimum(least, values.min(axis=0), out=least)
    return least


def bands(rows: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of a signature; the band's number is part of it."""
    rows = rows.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = _mix64(key * _U64(0x9E3779B97F4A7C15) + rows[:, r])
    return key.view(np.int64)


def bits(rows: np.ndarray) -> bytes:
    """Two mixed bits of each coordinate, as two planes of bits."""
    mixed = rows * np.uint32(0x9E3779B1)
    return np.packbits((mixed >> np.uint32(31)).astype(bool)).tobytes() + np.packbits((mixed >> np.uint32(30) & np.uint32(1)).astype(bool)).tobytes()


def least_agreement(percent: int) -> int:
    """Coordinates whose two bits agree, at least, of sets at the threshold but for DOUBT."""
    n, p = BANDS * ROWS, (1 + 3 * percent / 100) / 4
    return int(n * p - DOUBT * (n * p * (1 - p)) ** 0.5)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64())), ("bits", pa.binary())])
_TEXTS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("packed", pa.binary())])
_SETS = pa.schema([("cid", pa.int64()), ("set", pa.binary())])


def _text_hash(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def sign(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, row (a hash of the text), n_shingles, a 128-bit hash of the set, band keys and bits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict = {f.name: [] for f in _SIGNED}
            out["doc_id"] = b.column(0).to_pylist()
            keys = []
            for text in common.texts(b.column(1)):
                found = shingles(text, words)
                whole = xxhash.xxh3_128_intdigest(found.tobytes())
                out["row"].append(_text_hash(text.encode()))
                out["n_shingles"].append(len(found))
                out["set_a"].append((whole >> 64) - (1 << 63))
                out["set_b"].append((whole & ((1 << 64) - 1)) - (1 << 63))
                rows = signature(found) if len(found) else None
                keys.append(np.empty(0, np.int64) if rows is None else bands(rows))
                out["bits"].append(b"" if rows is None else bits(rows))
            out["bands"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys) if keys else [], pa.int64()))
            yield common.batch(_SIGNED, out)

    return common.need(docs, "doc_id", "text").mapInArrow(run, common.ddl(_SIGNED))


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """cid, set of the classes wanted (doc_id, row, cid); the texts move compressed."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            data = [t.encode() for t in common.texts(b.column(1))]
            yield common.batch(_TEXTS, {"doc_id": b.column(0).to_pylist(), "row": [_text_hash(x) for x in data], "packed": [press(x) for x in data]})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for b in batches:
            yield common.batch(_SETS, {"cid": b.column(0).to_pylist(), "set": [shingles(press.decompress(t.as_py(), max_output_size=1 << 31).decode(), words).tobytes() for t in b.column(1)]})

    packed = docs.mapInArrow(pack, common.ddl(_TEXTS)).join(wanted, ["doc_id", "row"]).select("cid", "packed")
    return packed.groupBy("cid").agg(F.first("packed").alias("packed")).mapInArrow(run, common.ddl(_SETS))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    full = pairs.join(sets.select(F.col("cid").alias("b"), F.col("set").alias("_y")), "b").join(sets.select(F.col("cid").alias("a"), F.col("set").alias("_x")), "a")
    return full.select("a", "b", "_x", "_y").mapInArrow(run, "a bigint, b bigint")


_MEMBERS = pa.schema([("key", pa.int64()), ("band", pa.int32()), ("cid", pa.int64()), ("n_shingles", pa.int64()), ("a", pa.int64()), ("na", pa.int64())])


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows key, band, cid, n_shingles sorted by key: those whose key another row has too, each
    beside cid and n_shingles (a, na) of the key's first row, the centre. Holds one row."""
    last: pa.RecordBatch | None = None
    out_last = False  # whether the row held belongs to the result already
    centre = (0, 0)  # of the row held
    for b in batches:
        if not len(b):
            continue
        whole = b if last is None else pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0]
        key, cid, n = (whole.column(k).to_numpy() for k in (0, 2, 3))
        same = key[1:] == key[:-1]
        keep = np.concatenate([[out_last], same]) | np.concatenate([same, [False]])
        start = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(key)), 0))
        a, na = cid[start], n[start]
        if last is not None:
            a[start == 0], na[start == 0] = centre
        beside = pa.RecordBatch.from_arrays([*whole.columns, pa.array(a), pa.array(na)], schema=_MEMBERS)
        yield beside.slice(0, len(whole) - 1).filter(pa.array(keep[:-1]))
        last, out_last, centre = whole.slice(len(whole) - 1), bool(keep[-1]), (a[-1], na[-1])
    if last is not None and out_last:
        yield pa.RecordBatch.from_arrays([*last.columns, pa.array([centre[0]]), pa.array([centre[1]])], schema=_MEMBERS)


_FACED = pa.schema([("key", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("left", pa.bool_()), ("cid", pa.int64()), ("n_shingles", pa.int64()), ("colour", pa.int64()), ("minor", pa.bool_()), ("band", pa.int32()), ("sketch", pa.binary())])
_SKETCH = pa.schema([("cid", pa.int64()), ("sketch", pa.binary())])


def _sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cid beside the bits and, for each band, 32 bits of its key."""
    for b in batches:
        keys = b.column(1).flatten().to_numpy().reshape(len(b), BANDS).astype(np.int32)
        yield common.batch(_SKETCH, {"cid": b.column(0).to_pylist(), "sketch": [x + k.tobytes() for x, k in zip(b.column(2).to_pylist(), keys)]})


def _near(percent: int):  # noqa: ANN202
    """Over blocks sorted by key, i, j: pairs of a left and a right member of different colours that
    may be similar enough, each where they first share a band."""
    least, half = least_agreement(percent), BANDS * ROWS // 8

    def face(rows: pa.RecordBatch) -> pa.RecordBatch:
        column = {f.name: rows.column(k) for k, f in enumerate(_FACED)}
        plain = {k: column[k].to_numpy(zero_copy_only=False) for k in ("left", "cid", "n_shingles", "colour", "minor", "band")}
        sketch = np.frombuffer(b"".join(column["sketch"].to_pylist()), np.uint8).reshape(len(rows), -1)
        planes, keys = sketch[:, : 2 * half].reshape(-1, 2, half), sketch[:, 2 * half :].copy().view(np.int32)
        right = np.flatnonzero(~plain["left"])
        cid, n, colour, minor = plain["cid"], plain["n_shingles"], plain["colour"], plain["minor"]
        a, b = [], []
        for x in np.flatnonzero(plain["left"]):
            y = right[colour[right] != colour[x]]
            y = y[(100 * np.minimum(n[y], n[x]) >= percent * np.maximum(n[y], n[x])) & (~minor[y] | (cid[y] > cid[x]))]
            differ = (planes[y, 0] ^ planes[x, 0]) | (planes[y, 1] ^ planes[x, 1])
            y = y[8 * half - np.bitwise_count(differ).sum(axis=1, dtype=np.int64) >= least]
            y = y[(keys[y] == keys[x]).argmax(axis=1) == plain["band"][x]]
            a.append(np.minimum(cid[x], cid[y]))
            b.append(np.maximum(cid[x], cid[y]))
        sides = [pa.array(np.concatenate(z) if z else [], pa.int64()) for z in (a, b)]
        return pa.RecordBatch.from_arrays(sides, names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for b in batches:
            if not len(b):
                continue
            place = np.stack([b.column(k).to_numpy() for k in range(3)])
            cuts = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1), len(b)]
            for start, end in zip(cuts[:-1], cuts[1:]):
                here = tuple(place[:, start])
                if held and here != at:
                    yield face(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held = []
                held.append(b.slice(start, end - start))
                at = here
        if held:
            yield face(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def _rest(members: DataFrame, label: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of a bucket across components that the centres did not tie, by their estimates.

    Every member apart from its bucket's most frequent component (a minor one) meets the members
    of other components. Both sides of a bucket are cut into blocks of BLOCK or so, by a hash; each
    pair of blocks is one group, however large the bucket."""
    coloured = common.checkpointed(members.join(label.withColumnRenamed("node", "cid"), "cid", "left").select("key", "band", "cid", "n_shingles", F.coalesce("component", "cid").alias("colour")))
    counted = coloured.groupBy("key", "colour").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "colour")).alias("_h"), F.sum("c").alias("n"))
    sizes = counted.where("n > _h.c").select(F.col("key").bitwiseXOR(F.lit(0)).alias("key"), F.col("_h.colour").alias("head"), F.ceil(F.col("n") / BLOCK).alias("nb"), F.ceil((F.col("n") - F.col("_h.c")) / BLOCK).alias("mb"))
    open_ = coloured.join(sizes, "key").withColumn("minor", F.col("colour") != F.col("head")).withColumn("at", F.xxhash64("cid"))
    sketches = classes.select("cid", "bands", "bits").mapInArrow(_sketches, common.ddl(_SKETCH))
    # a member goes to all blocks of the other side, and if it is minor, it stands on both sides
    side = lambda count: F.sequence(F.lit(0).cast("long"), F.col(count) - 1)
    right = F.transform(side("mb"), lambda i: F.struct(i.alias("i"), F.pmod("at", "nb").alias("j"), F.lit(False).alias("left")))
    left = F.transform(side("nb"), lambda j: F.struct(F.pmod("at", "mb").alias("i"), j.alias("j"), F.lit(True).alias("left")))
    placed = open_.join(sketches, "cid").withColumn("_p", F.explode(F.when(F.col("minor"), F.concat(right, left)).otherwise(right)))
    faced = placed.select("key", "_p.i", "_p.j", "_p.left", "cid", "n_shingles", "colour", "minor", "band", "sketch")
    return faced.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_near(percent), "a bigint, b bigint")


def _same_document(real: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: classes that rows of one doc_id belong to."""
    pair = F.struct("set_a", "set_b")
    several = common.checkpointed(real.groupBy("doc_id").agg(F.min(pair).alias("lo"), F.max(pair).alias("hi")).where("lo != hi").select("doc_id"))
    if several.isEmpty():
        return several.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    rows = real.select("doc_id", "set_a", "set_b").join(several, "doc_id").distinct().join(classes.select("set_a", "set_b", "cid"), ["set_a", "set_b"])
    return rows.join(rows.groupBy("doc_id").agg(F.min("cid").alias("b")), "doc_id").select(F.col("cid").alias("a"), "b")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs(doc_id, text)."""
    common.ready(docs.sparkSession)
    docs = common.need(docs, "doc_id", "text")
    signed = common.written(sign(docs, words))
    real = signed.where("n_shingles > 0 and doc_id is not null")
    # classes of equal sets; the row of the least id stands for all
    lead = real.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "row", "n_shingles", "bands", "bits")).alias("_l"))
    classes = common.written(lead.select("set_a", "set_b", "_l.*", F.monotonically_increasing_id().alias("cid")))
    # buckets of two classes or more, the class of the least hash as centre
    places = classes.select(F.posexplode("bands").alias("band", "key"), "cid", "n_shingles").select("key", "band", "cid", "n_shingles")
    members = common.checkpointed(places.repartition("key").sortWithinPartitions("key", F.xxhash64("cid")).mapInArrow(_shared, common.ddl(_MEMBERS)))
    first = members.where(f"a != cid and 100 * least(na, n_shingles) >= {percent} * greatest(na, n_shingles)").select("a", F.col("cid").alias("b")).distinct()
    involved = members.select("cid").distinct().join(classes.select("cid", "doc_id", "row"), "cid")
    sets = common.written(_sets(docs, involved, words))
    links = common.checkpointed(_confirmed(first, sets, percent).unionByName(_same_document(real, classes)))
    label = graph.components(links)
    more = common.checkpointed(_confirmed(_rest(members, label, classes, percent), sets, percent))
    if not more.isEmpty():
        label = graph.components(label.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    # a component's name is the least doc_id of its classes
    tied = classes.select("cid", "doc_id").join(label.withColumnRenamed("node", "cid"), "cid")
    names = tied.groupBy(F.col("component").alias("_c")).agg(F.min("doc_id").alias("component_id"))
    named = common.checkpointed(tied.join(names, tied["component"] == names["_c"]).select("cid", "component_id"))
    known = common.written(classes.select("set_a", "set_b", "cid", "doc_id").join(named, "cid", "left").select("set_a", "set_b", F.coalesce("component_id", "doc_id").alias("component_id")))
    own = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_a")).alias("set_a"), "set_b")
    whole = own.join(known, ["set_a", "set_b"], "left")
    component = F.coalesce("component_id", "doc_id")
    return whole.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), words=4, percent=80)


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents that are not the first, by doc_id, of their component. Rows
    without a doc_id stay."""
    gone = near_duplicates(docs, words, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


#: The same rows for DuckDB, by all pairs that share a shingle.
ORACLE_SQL = {
    "op6_minhash": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node),
m AS (SELECT node, min(c) AS c FROM r GROUP BY node)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, doc_id = m.c AS kept FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.node = doc_id
"""
}
