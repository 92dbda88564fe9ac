"""Best-fit packing of tokenized documents into sequences of a fixed length.

Best-two-fit: a bin is filled greedily, always with the longest piece that fits; then its smallest
piece is replaced by two unpacked ones if these fill the widened gap more tightly.

Only lengths matter for that, and there are at most `capacity` of them. So the plan is made on
their histogram: a bin's pattern of lengths is repeated as often as the counts allow. The driver
holds a histogram of at most `capacity` numbers and the plan's patterns, at any input size.
Pieces are then dealt to the plan's places by their rank among the pieces of their length, which
comes from counts of each partition: no piece is sorted, no key gathers rows.

Null texts count as empty and have one token, the end id. Repeated rows are packed each.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

CAPACITY, END_ID = 2048, 0
MEMO_ENTRIES, MEMO_LENGTH = 600_000, 64
#: Control characters that split() takes for white space and the tokenizer does not.
_ODD = "\x1c\x1d\x1e\x1f"
#: The tokenizer's own split, for lower-case text below U+0180.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_PIECE = re.compile(rf"[{_L}]++|'(?:s|t|re|ve|m|ll|d)|[{_N}]|[^{_S}{_L}{_N}]++")
#: The same for ASCII text.
_ASCII = re.compile(r"[a-z]++|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\t-\r a-z0-9]++")
_BEYOND = re.compile("[^\x00-ſ]")


class WordTokenizer:
    """Ids of whole texts by the tokenizers library, each different piece once.

    The tokenizer never forms a token across the pieces of its split, so a text's ids are those of
    its pieces in turn; they are kept in a bounded memo. Below U+0180 its normalization is lower
    case, character by character, and the split is done here. Other texts are cut at white space
    only, where normalization can't reach across; those with control characters on which both
    sides differ about white space are encoded whole."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        self.memo: dict[str, bytes] = {}
        suffix, vocabulary = self.tokenizer.model.end_of_word_suffix, self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a piece, each of them one
        for token, i in vocabulary.items():
            self.last[i] = bool(suffix) and token.endswith(suffix)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The same for pieces of the split, all in one text and told apart by the ids that end one."""
        ids = np.array(self.tokenizer.encode(" ".join(pieces), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(pieces) or ends[-1] != len(ids):
            return self._library(pieces)
        data, ends = ids.tobytes(), (4 * ends).tolist()
        return [data[a:z] for a, z in zip([0, *ends], ends)]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        fetch = self._pieces
        if text.isascii():
            words = _ASCII.findall(text.lower())
        elif not _BEYOND.search(text):
            words = _PIECE.findall(text.lower())
        elif any(c in text for c in _ODD):
            return self._library([text])[0]
        else:
            words, fetch = text.split(), self._library
        found = list(map(self.memo.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            new = list(dict.fromkeys([words[i] for i in missing]))
            made = dict(zip(new, fetch(new)))
            for i in missing:
                found[i] = made[words[i]]
            if len(self.memo) > MEMO_ENTRIES:
                self.memo.clear()
            self.memo.update((w, ids) for w, ids in made.items() if len(w) <= MEMO_LENGTH)
        return b"".join(found)


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("part", pa.int64()), ("at", pa.int64())])


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Documents as token pieces of at most `capacity`: doc_id, piece, start, length, ids_crc32,
    ids (null unless kept), and where it was made: part, and at, its number there among the
    pieces of its length. One narrow map; the tokenizer's definition is broadcast (a fixed MB)."""
    spark = common.ready(docs.sparkSession)
    with open(path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = common.WORKER.get("words")
        if kept is None or kept[0] != path:
            kept = common.WORKER["words"] = (path, WordTokenizer(shared.value))
        encode, part, seen = kept[1].encode, TaskContext.get().partitionId(), Counter()
        end = END_ID.to_bytes(4, "little")
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), common.texts(b.column(1))):
                ids = encode(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    rows.append((doc, k, at // 4, n, zlib.crc32(own), own if keep_ids else None, part, seen[n]))
                    seen[n] += 1
            yield common.batch(_PIECES, {f.name: [r[i] for r in rows] for i, f in enumerate(_PIECES)})

    return common.need(docs, "doc_id", "text").mapInArrow(run, common.ddl(_PIECES))


def _two(there: np.ndarray, counts: np.ndarray, room: int, more_than: int) -> tuple[int, int] | None:
    """The two available lengths of the largest sum in (more_than, room]; there is sorted."""
    if not len(there):
        return None
    longer = there[there < room]
    if not len(longer):
        return None
    at = np.searchsorted(there, room - longer, side="right") - 1
    longer, other = longer[at >= 0], there[at[at >= 0]]
    short = (longer == other) & (counts[longer] < 2)
    if short.any():  # the one piece of this length can't be taken twice: the next shorter one
        at = np.searchsorted(there, other[short]) - 1
        other = other.copy()
        other[short] = np.where(at >= 0, there[at], 0)
    total = np.where(other > 0, longer + other, 0)
    if not len(total) or total.max() <= more_than:
        return None
    best = int(total.argmax())
    return int(longer[best]), int(other[best])


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns of lengths and how many bins have each, by best-two-fit."""
    if any(not 0 < k <= capacity for k in histogram):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    counts = np.zeros(capacity + 1, np.int64)
    for k, v in histogram.items():
        counts[k] = v
    out: list[tuple[list[int], int]] = []
    while True:
        there = np.flatnonzero(counts)
        if not len(there):
            return out
        bin_, left, gap = [], counts.copy(), capacity
        while gap:
            at = int(np.searchsorted(there, gap, side="right")) - 1
            if at < 0:
                break
            length = int(there[at])
            times = min(gap // length, int(left[length]))
            bin_ += [length] * times
            left[length] -= times
            gap -= length * times
            if not left[length]:
                there = np.delete(there, at)
        if gap and len(bin_):
            small = bin_[-1]
            found = _two(there, left, gap + small, small)
            if found:
                bin_[-1:] = list(found)
        used = Counter(bin_)
        times = min(int(counts[k]) // n for k, n in used.items())
        for k, n in used.items():
            counts[k] -= n * times
        out.append((bin_, times))


class Places:
    """Where the pieces of each length go: runs of ranks with the first bin and the offset."""

    def __init__(self, patterns: list[tuple[list[int], int]]):
        runs: dict[int, list[tuple[int, int, int]]] = {}
        taken: Counter = Counter()
        first = 0
        for lengths, times in patterns:
            offset = 0
            for n in lengths:
                runs.setdefault(n, []).append((taken[n], first, offset))
                taken[n] += times
                offset += n
            first += times
        self.runs = {n: np.array(r, np.int64).T for n, r in runs.items()}
        self.bins = first

    def find(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bins, offsets = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
        for n in np.unique(lengths):
            own = lengths == n
            start, first, offset = self.runs[int(n)]
            at = np.searchsorted(start, ranks[own], side="right") - 1
            bins[own] = first[at] + ranks[own] - start[at]
            offsets[own] = offset[at]
        return bins, offsets


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with their sequence_id and offset. made: as of pieces(), already checkpointed, so
    that part and at stay as they are; its other columns are kept, and replaced if they are named
    sequence_id or offset. Without rows the result has none."""
    spark = made.sparkSession
    counted = made.groupBy("part", "length").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    histogram = {r[0]: r[1] for r in counted.groupBy("length").agg(F.sum("_n")).collect()}  # capacity rows at most
    shared = spark.sparkContext.broadcast(Places(plan(histogram, capacity)))
    kept = made.drop("sequence_id", "offset")
    ranked = kept.join(bases, ["part", "length"]).withColumn("_rank", F.col("_base") + F.col("at")).drop("_base")
    names = [c for c in kept.columns if c not in ("part", "at")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in names] + ["sequence_id bigint", "offset bigint"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins, offsets = shared.value.find(b.column("length").to_numpy(), b.column("_rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(bins), pa.array(offsets)], names=[*names, "sequence_id", "offset"])

    return ranked.select(*[f"`{n}`" for n in names], "_rank").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """pieces() and pack() of docs(doc_id, text)."""
    made = pieces(docs, path, capacity, keep_ids)
    return pack(common.checkpointed(made if keep_ids else made.drop("ids")), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack_documents(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
