import hashlib
import random
import re

from gridspark.llm import pii

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (2 if i % 2 else 1)
        total += d // 10 + d % 10
    return total % 10 == 0


def plain(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (14 <= len(digits) <= 19 and luhn(digits)) or k == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_are_the_patterns():
    random.seed(4)
    for _ in range(6000):
        text = "".join(random.choices(["@", ".", "-", "+", " ", "(", ")", "a", "b.c", "1", "25", "300", "4111111111111111", "x@y.z", "é", "\n"], k=random.randint(0, 14)))
        assert pii.base_spans(text) == plain(text), repr(text)
    for text in ("a" * 60_000 + "@", "1" * 60_000, "1." * 30_000, "+1((" * 20_000, "a@" * 30_000):
        pii.base_spans(text)  # in time that grows with the length


def test_field_finds_what_patterns_miss():
    model, table = pii.field(), pii.labelled(seed=123, copies=6)
    found = pii.field_spans(model, [t for t, _ in table])
    right = sum(len(set(a) & set(b)) for a, (_, b) in zip(found, table))
    assert right >= 0.9 * sum(len(b) for _, b in table) and right >= 0.9 * sum(map(len, found))
    text = "call me: tel 555-123-4567 or write to anna at mail dot com please"
    (base, every), = pii.spans(model, [text])
    assert not base and {(k, text[a:b]) for a, k, b in every} == {(3, "555-123-4567"), (0, "anna at mail dot com")}


def test_forms_that_training_never_saw():
    """Precision and recall of the whole operator on held-out forms, and quiet on ordinary prose."""
    model, table = pii.field(), pii.labelled(seed=321, copies=12, held=True)
    right = wrong = whole = 0
    for (_, gold), (_, every) in zip(table, pii.spans(model, [t for t, _ in table])):
        right, wrong, whole = right + len(set(gold) & set(every)), wrong + len(set(every) - set(gold)), whole + len(gold)
    assert right >= 0.65 * whole and wrong <= 0.1 * right, (right, wrong, whole)
    r = random.Random(5)
    calm = [pii.prose(r, 200) for _ in range(200)]
    assert sum(map(len, pii.field_spans(model, calm))) == 0


def test_windows_are_the_whole_text_decoded():
    """Whole texts in one chain, labels other than O barred away from triggers, against the windows."""
    import numpy as np

    model, r = pii.field(), random.Random(11)
    taught, held, none = pii._makers(r)
    texts = []
    for _ in range(150):
        parts = [pii.prose(r, 40) for _ in range(5)]
        texts.append(" ".join(x for p in parts for x in (p, r.choice([*(m for _, m in taught + held), *none])())))
    for text, got in zip(texts, pii.field_spans(model, texts)):
        places, rows = pii.features(text)
        inside = np.zeros(len(text) + 1, bool)
        for a, b in pii.windows(text):
            inside[a:b] = True
        s = model.scores(rows)
        s[~inside[[a for a, _ in places]], 1:] = -1e6
        labels = model.viterbi(s[None], np.array([len(rows)]))[0]
        assert pii.spans_of(labels.tolist(), places) == got, text


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    model = pii.field()
    rng = np.random.default_rng(0)
    k = len(pii.LABELS)
    for n in (1, 2, 3):
        s = rng.normal(size=(1, n, k)) * 3
        move = model.move + model.barred
        start = [-1e9 if x[0] == "I" else 0.0 for x in pii.LABELS]
        best = max(itertools.product(range(k), repeat=n), key=lambda p: start[p[0]] + sum(s[0, i, y] for i, y in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:])))
        assert tuple(model.viterbi(s, np.array([n]))[0]) == best


def test_query_form_and_redaction(spark, docs_of, odd):
    rows = [*odd, (9, "mail a.b@c.example.com or +1 (269) 555-3296 now 1.2.3.4")]
    df = docs_of(rows)
    got = {(r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]): r for r in pii.find_pii(df).collect()}
    r = got[(9, 1, 1, 0, 1)]
    spans = "email:5:22,phone:26:43,ip:48:55"
    assert r["spans"] == spans and r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
    out = pii.redact(df)
    assert out.columns == df.columns and out.count() == len(rows)
    assert out.where("doc_id = 9").first()["text"] == "mail <EMAIL> or <PHONE> now <IP>" and out.where("n_chars != char_length(text)").count() == 0
    assert pii.find_pii(docs_of([])).count() == 0 and pii.redact(docs_of([])).count() == 0
