import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from gridspark.llm import anchors, suffixes


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(1500):
        x = np.array(rng.choices(range(1, rng.choice([2, 3, 9]) + 1), k=rng.randint(0, 40)), np.int64)
        assert suffixes.suffix_array(x, 9).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())
    big = np.random.default_rng(1).integers(1, 3, 5000)
    assert suffixes.suffix_array(big, 1 << 40).tolist() == suffixes.suffix_array(big, 2).tolist()


def test_anchors_depend_on_the_window_alone(monkeypatch):
    rng = random.Random(3)
    shared = bytes(rng.choices(range(97, 101), k=400))
    for lead in (0, 1, 77, 250):
        data = bytes(rng.choices(range(97, 101), k=lead)) + shared
        got = anchors.contexts(data)
        at = {p - f: g for g, f, z, p in zip(got[0], got[2], got[3], got[4])}
        places = {w - lead: int(p) - lead for f, z, p in zip(*got[2:]) for w in range(f, z + 1) if w >= lead}
        if lead == 0:
            first = places
        assert places == first and at
    monkeypatch.setattr(anchors, "BLOCK", 90)
    got = anchors.contexts(shared)
    assert {w: int(p) for f, z, p in zip(*got[2:]) for w in range(f, z + 1)} == first


def brute(rows, width=200):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + width] for b in data for i in range(len(b) - width + 1))
    out = []
    for (d, _), b in zip(rows, data):
        on = np.zeros(len(b) + 1, int)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                on[i] += 1
                on[i + width] -= 1
        gone = np.cumsum(on)[:-1] > 0
        out.append((d, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("hot", "block"), [(4000, 1_500_000), (2, 3000)])
def test_against_brute_force(spark, docs_of, odd, hot, block, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT_ROWS", hot)
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", block)
    if hot == 2:
        monkeypatch.setattr(suffixes, "HOT_SHARE", 10**6)
    rng = random.Random(4)
    text = lambda n: "".join(rng.choices("abcdé fgh", k=n))
    passages = [text(n) for n in (150, 199, 200, 230, 600)]
    rows = [*odd, (50, "ab " * 400), (51, text(900) * 2)]
    for i in range(70):
        rows.append((100 + i, text(rng.randint(0, 300)) + rng.choice(passages) + text(rng.randint(0, 300))))
        rows.append((200 + i, text(rng.randint(0, 3)) + passages[4][: rng.randint(190, 600)] + text(rng.randint(0, 4))))
    got = sorted(map(tuple, suffixes.remove_repeats(docs_of(rows), digests=True).collect()), key=str)
    assert got == brute(rows)
    if hot == 4000:
        assert suffixes.remove_repeats(docs_of([])).count() == 0
        one = suffixes.remove_repeats(docs_of([(1, "x" * 10 + passages[4]), (2, passages[4])])).collect()
        assert {r["doc_id"]: bytes(r["kept"]) for r in one} == {1: b"x" * 10, 2: b""}
