import math
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from gridspark.llm import queries
from tests.llm.test_lines import distance
from tests.llm.test_minhash import brute as brute_components
from tests.llm.test_pii import PATTERNS, plain
from tests.llm.test_quality import measured


def test_stages_keep_the_columns_and_take_effect(spark, docs_of, odd):
    rng = random.Random(1)
    words = ["".join(rng.choices("aeiourstlnm", k=rng.randint(2, 9))) for _ in range(400)]
    text = lambda n: "\n".join(" ".join(rng.choices(words, k=30)) for _ in range(n))
    rows = [*odd, *((100 + i, text(3)) for i in range(40))]
    copy = rows[-1][1]
    rows += [(900, copy), (901, copy.replace(" ", "  ", 1)), (902, text(3) + "\nwrite to jo@mail.example.com today, please do")]
    docs = docs_of(rows, extra=False)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and {r["doc_id"] for r in docs.collect()} <= before, name
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {100 + i for i in range(40)} <= set(left) and 900 not in left and "<EMAIL>" in left[902]
    packed = corpus_pipeline.pack(spark, docs, "").collect()
    assert {r["doc_id"] for r in packed} == set(left)


def test_empty_table_runs_through(spark, docs_of):
    docs = docs_of([], extra=False)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]


# --- the whole chain by brute force: plain Python, none of the operators' code ---------------


def good_ones(docs):
    """Adaptive limits from all values, in plain lists."""
    names = ("symbol_ratio", "word_length", "dup_line_ratio", "repeat_ratio")
    share, floor, growth = {"symbol_ratio": 0.95, "dup_line_ratio": 0.98, "repeat_ratio": 0.98}, {"word_length": 0.0}, 1.01 / 0.99
    values = {}
    for d, t, lang, source in docs:
        n, chars, symbols, dup, repeat, failed = measured(t)
        lines = sum(bool(x.split()) for x in t.split("\n"))
        if not failed:
            values[d] = dict(zip(names, (symbols / n, chars / n, dup / max(1, lines), repeat / n)))

    def limit(some, k):
        b = sorted(-(10**9) if v <= 1e-4 else math.ceil(math.log(v) / math.log(growth)) for v in some)
        at = lambda q: b[math.ceil(len(b) * q) - 1]
        mid = lambda x: 2 * growth**x / (growth + 1) if x > -(10**9) else 0.0
        q1, q3 = mid(at(0.25)), mid(at(0.75))
        wide = max(q3 - q1, 0.02 * q3) * 3
        top = at(share.get(k, 0.75))
        return q1 - wide, q3 + wide if k == "word_length" else growth**top if top > -(10**9) else 0.0

    keep = []
    for d, t, lang, source in docs:
        if d not in values:
            continue
        fine = True
        for k in names:
            groups = [[values[x][k] for x, _, g, s in docs if x in values and fits(g, s)] for fits in (lambda g, s: (g, s) == (lang, source), lambda g, s: g == lang, lambda g, s: True)]
            (own, lang_, all_), sizes = [limit(g, k) for g in groups], [len(g) for g in groups]
            low, high = ((sizes[0] * own[i] + 100 * (sizes[1] * lang_[i] + 100 * all_[i]) / (sizes[1] + 100)) / (sizes[0] + 100) for i in (0, 1))
            fine = fine and values[d][k] <= max(high * (1 + 1e-9), floor.get(k, 0.01)) and (k != "word_length" or values[d][k] >= low * (1 - 1e-9))
        if fine:
            keep.append((d, t))
    return keep


def without_near_lines(docs):
    seen, out = [], []
    for d, t in sorted(docs):
        kept = []
        for x in t.split("\n"):
            if x.strip():
                gone = any(x == y or min(len(x), len(y)) >= 20 and abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2 for y in seen)
                seen.append(x)
                if gone:
                    continue
            kept.append(x)
        if any(x.split() for x in kept) or "\n".join(kept) == t:
            out.append((d, "\n".join(kept)))
    return out


def test_run_is_the_chain_by_brute_force(spark, tmp_path):
    rng = random.Random(31)
    words = ["".join(rng.choices("aeiourstlnm", k=rng.randint(2, 9))) for _ in range(300)]
    line = lambda: " ".join(rng.choices(words, k=rng.randint(8, 14)))
    common_line = line()
    docs = []
    for i in range(70):
        t = [line() for _ in range(rng.randint(3, 7))]
        if i % 5 == 0:
            t.insert(1, common_line + rng.choice(["", "x", "!!"]))
        if i % 7 == 0:
            t.append("write to jo.e@mail.example.com or +1 (269) 555-3296 from 10.20.30.40")
        docs.append((i, "\n".join(t), rng.choice(["en", "fr"]), rng.choice(["web", "books"])))
    for i in range(70, 90):  # copies with words put in: lines further than two edits, texts nearly equal
        t = [x.split() for x in rng.choice(docs[:20])[1].split("\n")]
        for x in t:
            x.insert(rng.randrange(len(x)), rng.choice(words)) if rng.random() < 0.3 else None
        docs.append((i, "\n".join(" ".join(x) for x in t), "en", "web"))
    docs += [(90, " ".join(f"{w}***" for w in rng.sample(words, 60)), "en", "web"), (91, "too short", "en", "web"), (92, "", "fr", "web"), (93, ("a b c " * 40).strip(), "fr", "books")]
    spark.createDataFrame([(*r, len(r[1])) for r in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    left = without_near_lines(good_ones(docs))
    component = brute_components(left, 5, 80)
    left = [(d, t) for d, t in left if component[d] == d]
    assert 40 < len(left) < 93
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, t in left:
        out, done = [], 0
        for a, k, b in plain(t):
            if a >= done:
                out += [t[done:a], f"<{('EMAIL', 'IP', 'CARD', 'PHONE')[k]}>"]
            done = max(done, b)
        ids = [*library.encode("".join([*out, t[done:]]), add_special_tokens=False).ids, 0]
        for n, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            want.append((d, n, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want) and len(PATTERNS) == 4
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 2048) + 1
