import hashlib
import random

import pytest

from gridspark.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(text, k, rng, letters="abc"):
    s = list(text)
    for _ in range(k):
        what, at = rng.randint(0, 2), rng.randint(0, len(s))
        if what == 0:
            s.insert(at, rng.choice(letters))
        elif s and what == 1:
            del s[min(at, len(s) - 1)]
        elif s:
            s[min(at, len(s) - 1)] = rng.choice(letters)
    return "".join(s)


def test_band_is_the_edit_distance():
    rng = random.Random(5)
    for _ in range(8000):
        a = "".join(rng.choices("abc", k=rng.randint(0, 14)))
        b, k = changed(a, rng.randint(0, 5), rng), rng.randint(0, 3)
        assert lines.within(a, b, k) == (distance(a, b) <= k), (a, b, k)


def test_segments_meet_every_pair():
    rng = random.Random(6)
    for k in (1, 2, 3):
        for _ in range(1500):
            a = "".join(rng.choices("ab", k=rng.randint(22, 40)))
            b = changed(a, k, rng, "ab")
            if len(b) < lines.LEAST or distance(a, b) > k:
                continue
            keys = [set(lines.line_keys(x, k)) for x in (a, b)]
            assert any((key, not own) in keys[1] for key, own in keys[0]), (a, b)


def brute(rows, k):
    first, places = {}, []
    for d, t in rows:
        row = lines._row_key(d, (t or "").encode())
        for n, x in lines._lines(t or ""):
            places.append(((d is None, d or 0, row, n), x))
    for p, x in places:
        first[x] = min(p, first.get(x, p))
    late = {y for y in first if any(first[x] < first[y] and x != y and abs(len(x) - len(y)) <= k and distance(x, y) <= k for x in first)}
    out = []
    for d, t in rows:
        row, equal, near, kept = lines._row_key(d, (t or "").encode()), 0, 0, []
        compared = dict(lines._lines(t or ""))
        for n, x in enumerate((t or "").split("\n")):
            if n in compared and (x in late or first[x] != (d is None, d or 0, row, n)):
                equal, near = (equal, near + 1) if first[x] == (d is None, d or 0, row, n) else (equal + 1, near)
            else:
                kept.append(x)
        out.append((d, len((t or "").split("\n")), equal, near, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowd", [48, 3, 2])
def test_against_brute_force(spark, docs_of, odd, crowd, monkeypatch):
    monkeypatch.setattr(lines, "CROWD", crowd)
    monkeypatch.setattr(lines, "MOST", 1500 if crowd == 48 else 4 if crowd == 3 else 1500)
    rng = random.Random(9)
    base = ["".join(rng.choices("abcdefgh ", k=rng.randint(21, 60))) for _ in range(12)]
    rows = [(d, t) for d, t in odd if d != 4] + [(100 + i, "\n".join(changed(base[0] if rng.random() < 0.4 else rng.choice(base), rng.choice([0, 0, 1, 2, 3, 5]), rng) if rng.random() < 0.9 else "short" for _ in range(rng.randint(0, 4)))) for i in range(110)]
    got = sorted(map(tuple, lines.line_dedup_digests(docs_of(rows)).collect()), key=str)
    assert got == brute(rows, 2) and sum(r[3] for r in got) > 20
    if crowd == 48:
        out = lines.line_dedup(docs_of(rows))
        assert out.columns == docs_of(rows).columns and out.where("n_chars != char_length(text)").count() == 0
        assert {r["doc_id"] for r in out.collect()} >= {1, 2, 3}
        assert lines.line_dedup(docs_of([])).count() == 0 and lines.line_dedup_digests(docs_of([])).count() == 0


def test_lines_together_after_all_cuts(spark, docs_of, odd, monkeypatch):
    """Without cuts, crowded keys are dealt in blocks of four lines or so."""
    monkeypatch.setattr(lines, "CROWD", 2)
    monkeypatch.setattr(lines, "MOST", 4)
    monkeypatch.setattr(lines, "LEVELS", 0)
    monkeypatch.setattr(lines, "HELD", 30)
    rng = random.Random(19)
    base = ["".join(rng.choices("abcdefgh ", k=rng.randint(21, 60))) for _ in range(3)]
    rows = [(d, t) for d, t in odd if d != 4] + [(100 + i, "\n".join(changed(rng.choice(base), rng.choice([0, 1, 2, 3, 5]), rng) for _ in range(rng.randint(0, 4)))) for i in range(60)]
    got = sorted(map(tuple, lines.line_dedup_digests(docs_of(rows)).collect()), key=str)
    assert got == brute(rows, 2) and sum(r[3] for r in got) > 20


def test_equal_lines_of_any_length_go(spark, docs_of):
    # split here without the module's help; short lines near each other stay
    rows = [(1, "Read more\nx\n\n \nShare this"), (2, "Read more\nRead mores\n\n \nx"), (3, "one line of more than twenty letters\nShare this\nShare this"), (4, "x\none line of more than twenty lettersss")]
    seen, want = [], {}
    for d, t in rows:
        kept, equal, near = [], 0, 0
        for x in t.split("\n"):
            if x.strip() and x in seen:
                equal += 1
            elif len(x) >= 20 and any(len(y) >= 20 and distance(x, y) <= 2 for y in seen):
                near += 1
            else:
                kept.append(x)
            seen.append(x)
        want[d] = (len(t.split("\n")), equal, near, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    df = docs_of(rows)
    assert {r[0]: tuple(r)[1:] for r in lines.line_dedup_digests(df).collect()} == want
    assert [want[d][1:3] for d in (1, 2, 3, 4)] == [(0, 0), (2, 0), (2, 0), (1, 1)]
    assert {r["doc_id"]: r["text"] for r in lines.line_dedup(df).collect()} == {1: rows[0][1], 2: "Read mores\n\n ", 3: "one line of more than twenty letters"}
