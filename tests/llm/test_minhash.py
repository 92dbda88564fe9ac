import random

import numpy as np

from gridspark.llm import graph, minhash


def brute(rows, words, percent):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(d, []).append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    ids = [d for d in sets if d is not None]
    label = {d: d for d in ids}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = root(a), root(b)
                label[max(p, q)] = min(p, q)
    return {d: root(d) for d in ids}


def test_against_brute_force(spark, docs_of, odd):
    random.seed(3)
    words = [f"w{i}" for i in range(500)]
    base = [random.choices(words, k=80) for _ in range(6)]
    rows = list(odd)
    passage = random.choices(words, k=30)
    for i in range(120):
        t = list(random.choice(base))
        for _ in range(random.randint(0, 6)):
            t[random.randrange(len(t))] = random.choice(words)
        rows.append((100 + i, " ".join(t)))
        rows.append((300 + i, " ".join([*random.choices(words, k=random.randint(5, 40)), *passage])))
    got = minhash.near_duplicates(docs_of(rows), words=4, percent=80).collect()
    want = brute(rows, 4, 80)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)
    out = minhash.deduplicate(docs_of(rows), words=4)
    assert out.columns == docs_of(rows).columns and {r["doc_id"] for r in out.collect()} == {None, *want.values()}
    assert minhash.near_duplicates(docs_of([])).count() == 0


def test_dense_group_around_the_threshold(spark, docs_of, monkeypatch):
    """One group whose pairs lie at 0.55 to 0.95: what the centres leave is told in small blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    base = rng.choices(words, k=150)
    rows = []
    for i in range(160):
        t = list(base)
        for _ in range(rng.choice([1, 2, 4, 6, 8, 9, 10])):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t)))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs_of(rows), words=4, percent=80).collect()}
    want = brute(rows, 4, 80)
    assert got == want and 20 < len(set(want.values())) < 140


def test_one_document_of_two_texts(spark, docs_of):
    rng = random.Random(4)
    one, two = ([rng.choice("abcdefghij") + str(rng.randrange(900)) for _ in range(80)] for _ in range(2))
    near = lambda t, w: " ".join([*t[:-1], w])
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, near(one, "x")), (3, near(two, "y")), (4, " ".join(two)), (9, "some other words of a text")]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs_of(rows), words=4, percent=80).collect()}
    assert got == brute(rows, 4, 80) == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8):
        a = np.unique(rng.integers(0, 2**63, 2000, dtype=np.uint64))
        b = np.concatenate([a[: int(len(a) * 2 * share / (1 + share))], np.unique(rng.integers(0, 2**63, int(len(a) * (1 - share) / (1 + share)), dtype=np.uint64))])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((minhash.signature(a) == minhash.signature(b)).mean() - true) < 0.06


def test_permutation_is_one():
    x = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65537)
    assert len(np.unique(minhash._permute(x.copy(), 0xCC9E2D51, 0x1B873593))) == len(x)


def test_components(spark):
    random.seed(8)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(None, 1), (5, 5)]
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            p, q = root(a), root(b)
            label[max(p, q)] = min(p, q)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(label)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
