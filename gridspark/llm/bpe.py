"""Byte-level BPE encoding and decoding.

Two tiers. A minimal perfect hash over the vocabulary resolves every whole pre-token that is
itself a token. A pre-token that is not is split into bytes held in a linked list, and a heap of
mergeable neighbours is drained lowest rank first, leftmost first among equals. Decoding is the
concatenation of the tokens' bytes.

Null texts count as empty; an empty text has no ids and decodes to no bytes. Repeated rows give
repeated results. Texts are encoded whole, of any length; special tokens are never formed.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from . import common

_MASK = (1 << 64) - 1
_GOLDEN = 0x9E3779B97F4A7C15
#: Texts that a worker's pre-token memo may hold before it is emptied.
MEMO_ENTRIES = 600_000
#: Longer pre-tokens are not kept in the memo.
MEMO_LENGTH = 64


def _slot(h: int, d: int, n: int) -> int:
    x = ((h ^ (d * _GOLDEN)) * 0xD6E8FEB86659FD93) & _MASK
    return (x >> 32) % n


class PerfectHash:
    """A minimal perfect hash: n keys onto n slots, by hash and displace.

    Keys go to buckets by one half of a 64-bit hash. From the largest bucket on, each gets the
    first displacement that sends its keys to free slots; buckets of one key point at a slot."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 3)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        if len(set(hashes)) != n:
            raise ValueError("keys repeat, or two keys share a 64-bit hash")
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            groups[(h >> 32) % self.buckets].append(i)
        self.shift = [0] * self.buckets
        self.key_at: list[int] = [-1] * n
        order = sorted((g for g in range(self.buckets) if groups[g]), key=lambda g: (-len(groups[g]), g))
        single = len(order)
        for at, g in enumerate(order):
            own = groups[g]
            if len(own) == 1:
                single = at
                break
            d = 0
            while True:
                slots = [_slot(hashes[i], d, n) for i in own]
                if len(set(slots)) == len(slots) and all(self.key_at[s] < 0 for s in slots):
                    break
                d += 1
            self.shift[g] = d
            for i, s in zip(own, slots):
                self.key_at[s] = i
        free = iter([s for s in range(n) if self.key_at[s] < 0])
        for g in order[single:]:
            s = next(free)
            self.key_at[s] = groups[g][0]
            self.shift[g] = -s - 1

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[(h >> 32) % self.buckets]
        return -d - 1 if d < 0 else _slot(h, d, self.n)


class Vocabulary:
    """Tokens by rank, the perfect hash over them, and the ranks of adjacent pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary must hold every single byte")
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.slot_key = [keys[i] for i in self.hash.key_at]
        self.slot_rank = [ranks[k] for k in self.slot_key]
        self.byte_rank = [ranks[bytes([b])] for b in range(256)]
        #: left rank << 32 | right rank -> rank of their concatenation, for every split of every token
        self.pair = {ranks[t[:i]] << 32 | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}

    def whole(self, piece: bytes) -> int:
        """First tier: the rank of a pre-token that is a token, else -1."""
        s = self.hash.slot(piece)
        return self.slot_rank[s] if self.slot_key[s] == piece else -1

    def merge(self, piece: bytes) -> list[int]:
        """Second tier: a heap over linked bytes. Entries are rank, left node and both ranks
        as they were; an entry whose nodes have changed since is stale."""
        n, pair = len(piece), self.pair
        rank = [self.byte_rank[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            k = rank[i] << 32 | rank[i + 1]
            if k in pair:
                heap.append((pair[k], i, k))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            r, i, k = pop(heap)
            j = after[i]
            if j >= n or rank[i] != k >> 32 or rank[j] != k & 0xFFFFFFFF:
                continue
            rank[i], rank[j] = r, -1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                k = r << 32 | rank[j]
                if k in pair:
                    push(heap, (pair[k], i, k))
            h = before[i]
            if h >= 0:
                k = rank[h] << 32 | r
                if k in pair:
                    push(heap, (pair[k], h, k))
        return [r for r in rank if r >= 0]

    def piece(self, piece: bytes) -> list[int]:
        r = self.whole(piece)
        return [r] if r >= 0 else self.merge(piece)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


#: The letters, numbers and white space below U+0250, for the usual texts that stay below it.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_LATIN = rf"[ ]?[{_L}]++|[ ]?[{_N}]++|'s|'t|'re|'ve|'m|'ll|'d|[ ]?[^{_S}{_L}{_N}]++|[{_S}]+(?![^{_S}])|[{_S}]+"


class Encoder:
    """Encodes and decodes whole texts. latin: whether the split pattern is the usual one, for
    which a faster equal form exists on texts without characters from U+0250 on."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, latin: bool = True):
        self.vocabulary = vocabulary
        self.find = regex.compile(pattern).findall
        self.find_latin = re.compile(_LATIN).findall if latin else self.find
        self.beyond = re.compile("[^\x00-ɏ]").search
        self.memo: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        if text.isascii() or not self.beyond(text):
            return self.find_latin(text)
        return self.find(text)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        pieces, memo = self.split(text), self.memo
        try:
            return b"".join(map(memo.__getitem__, pieces))
        except KeyError:
            pass
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        local = {}
        for p in set(pieces):
            ids = memo.get(p)
            if ids is None:
                ids = b"".join(i.to_bytes(4, "little") for i in self.vocabulary.piece(p.encode()))
                if len(p) <= MEMO_LENGTH:
                    memo[p] = ids
            local[p] = ids
        return b"".join(map(local.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_VOCABULARIES: dict = {}


def vocabulary(path: str) -> Vocabulary:
    """Built once a driver process; its size is that of the vocabulary file, whatever the data."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(load_ranks(path))
    return _VOCABULARIES[path]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode_decode(docs: DataFrame, path: str, pattern: str, digests: bool = False) -> DataFrame:
    """Encode `text` of docs(doc_id, text) and decode the ids again.

    Returns doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded; with digests the
    lowercase SHA-256 of both instead, made in the same pass. One narrow map, no shuffle; the
    vocabulary is broadcast, a fixed few MB.
    Nulls: a null text is empty, a null doc_id stays null. An empty table gives an empty result."""
    from public_tokenizers import PATTERN

    spark = common.ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(vocabulary(path))
    latin, schema = pattern == PATTERN, _DIGESTS if digests else _OUT

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = common.WORKER.get("bpe")
        if kept is None or kept[0] != (path, pattern):
            kept = common.WORKER["bpe"] = ((path, pattern), Encoder(shared.value, pattern, latin))
        encoder = kept[1]
        for b in batches:
            n, ids_out, decoded_out = [], [], []
            for text in common.texts(b.column(1)):
                ids = encoder.encode(text)
                decoded = encoder.decode(ids)
                n.append(len(ids) // 4)
                ids_out.append(hashlib.sha256(ids).hexdigest() if digests else ids)
                decoded_out.append(hashlib.sha256(decoded).hexdigest() if digests else decoded)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids_out, schema[2].type), pa.array(decoded_out, schema[3].type)], schema=schema)

    return common.need(docs, "doc_id", "text").mapInArrow(run, common.ddl(schema))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    import public_tokenizers

    return encode_decode(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
