import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from gridspark.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal():
    keys = list(bpe.load_ranks(PATH))[:5000]
    h = bpe.PerfectHash(keys)
    assert sorted(h.slot(k) for k in keys) == list(range(len(keys)))


def test_same_ids_as_the_library(reference):
    encoder = bpe.Encoder(bpe.vocabulary(PATH), P.PATTERN)
    random.seed(1)
    letters = "ab \n\t'sdét1२ 你😀\x85\x1c\xa0 _-ſǅ"
    texts = ["", "a" * 5000, "ab" * 4000, "don't  stop\n\n", *("".join(random.choices(letters, k=random.randint(0, 60))) for _ in range(4000))]
    texts += [f"a {chr(c)}b1{chr(c)} " for c in [*range(0, 0x600), *range(0x2000, 0x2070), 0x3000, 0xFEFF, 0x1F600]]
    for t in texts:
        ids = encoder.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t), repr(t)
        assert encoder.decode(ids) == t.encode()


def test_query_form(spark, docs_of, odd, reference):
    got = sorted(map(tuple, bpe.encode_decode(docs_of(odd), PATH, P.PATTERN, digests=True).collect()), key=str)
    want = []
    for d, t in odd:
        ids = reference.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode_decode(docs_of([]), PATH, P.PATTERN).count() == 0
