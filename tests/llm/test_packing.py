import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from gridspark.llm import packing

PATH = P.path("word_bpe_49k.json")


def test_same_ids_as_the_library():
    words = packing.WordTokenizer(open(PATH, encoding="utf-8").read())
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    random.seed(3)
    letters = "abSTré'İΣς 12\n\t\x85\xa0\x1c\x1f.,!é̈你ſƁ"
    texts = ["", "It's a “Test”... 'sss ''s", *("".join(random.choices(letters, k=random.randint(0, 30))) for _ in range(4000)), *(f"a{chr(c)}b 1{chr(c)}'s {chr(c)}" for c in [*range(0x700), *range(0x1E00, 0x2100), 0x3000, 0x212A])]
    for t in texts:
        assert np.frombuffer(words.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_plans_are_whole_and_tight():
    random.seed(6)
    for n, top in ((1, 2048), (400, 2048), (3000, 900), (500, 60), (50, 1025)):
        h = Counter(random.randint(1, top) for _ in range(n))
        out = packing.plan(dict(h))
        placed = Counter()
        for lengths, times in out:
            assert sum(lengths) <= 2048 and times > 0
            for x in lengths:
                placed[x] += times
        assert placed == h
        bins, total = sum(t for _, t in out), sum(k * v for k, v in h.items())
        assert bins <= max(1.03 * total / 2048 + 2, sum(v for k, v in h.items() if k > 1024))
    assert packing.plan({}) == []


def test_two_replace_one():
    # greedily 10 + 5 with a gap of 3; 4 and 4 instead of 5 leave none
    assert packing.plan({10: 1, 5: 1, 4: 2}, 18)[0] == ([10, 4, 4], 1)


def test_query_form(spark, docs_of, odd):
    rows = [*odd, *((100 + i, "some words " * random.Random(i).randint(0, 900)) for i in range(60))]
    out = packing.pack_documents(docs_of(rows), PATH).collect()
    library = Tokenizer.from_file(PATH)
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(d, k, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out), key=str) == sorted(want, key=str)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= sum(r["length"] for r in out) / 2048 * 1.03 + 2
    assert packing.pack_documents(docs_of([]), PATH).count() == 0
