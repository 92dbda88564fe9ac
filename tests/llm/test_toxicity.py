import math
import random
import re
import zlib

from gridspark.llm import toxicity
from tests.llm.test_lines import changed, distance


def test_automaton_is_the_edit_distance():
    rng = random.Random(1)
    terms = ["stupid", "worthless", "scum", "moron", "abcabcabc", "idiots"]
    m = toxicity.Matcher(terms)
    for _ in range(6000):
        w = changed(rng.choice(terms), rng.randint(0, 4), rng, "abcdeiomnprstuw")
        near = [(distance(w, t), i) for i, t in enumerate(terms) if distance(w, t) <= toxicity.allowed(t)]
        assert m.find(w) == (min(near) if near else None), w
    begins = toxicity.Matcher(["lowei*", "moron"])
    assert begins.find("loweichen") == (0, 0) and begins.find("low") is None and begins.find("moronx") == (1, 1)
    # beginnings allow edits too: the least distance to a beginning of the word
    terms = ["stupid*", "worthless*", "scum*", "idiot"]
    m = toxicity.Matcher(terms)
    for _ in range(3000):
        w = changed(rng.choice(terms).rstrip("*"), rng.randint(0, 3), rng, "abcdeiomnprstuw") + rng.choice(["", "ity", "s", "xyz"])
        near = [(min(distance(w[:k], t.rstrip("*")) for k in range(len(w) + 1)) if t.endswith("*") else distance(w, t), i) for i, t in enumerate(terms)]
        near = [(e, i) for e, i in near if e <= toxicity.allowed(terms[i].rstrip("*"))]
        assert m.find(w) == (min(near) if near else None), w
    # words of any length are looked up
    assert m.find("stupid" + "t" * 500) == m.look("stupid" + "t" * 500) == (0, 0)


def test_misspellings_raise_and_quotations_lower():
    terms = ["stupid", "worthless"]
    m = toxicity.Matcher(terms, [3.0, 3.0])
    model = (terms, [3.0, 3.0], m.edits, toxicity.np.array([-4.0, 1.0, 1.0, 5.0]))
    score = lambda t: toxicity.score_of(model, m, t)
    clean, near, exact = (score(f"you are so {w} and nothing else my dear friend") for w in ("clever", "stupyd", "stupid"))
    assert clean < near < exact
    for quoted in ('he went "you are stupid" and was shown out of it', "the word stupid was what they used in the letter", "« tu es stupid » et rien de plus mon cher ami"):
        assert clean < score(quoted) < exact
    assert toxicity.features(m, "") == toxicity.features(m, "clean words only") == [1.0] + [0.0] * (toxicity.N_FEATURES - 1)


def brute_score(model, text):
    """Every word against every term."""
    terms, weights, edits, w = model
    lower = text.lower()
    found = list(re.finditer(r"[^\W\d_]+", lower))
    words = [x[0] for x in found]
    total, best = 0.0, {}
    for i, word in enumerate(words):
        near = [(min(distance(word[:k], t[:-1]) for k in range(len(word) + 1)) if t.endswith("*") else distance(word, t), n) for n, t in enumerate(terms) if t.endswith("*") or abs(len(t) - len(word)) <= 2]
        near = [x for x in near if x[0] <= edits[x[1]]]
        if not near:
            continue
        e, n = min(near)
        a, b = max(0, i - 6), min(len(words), i + 7)
        marks = all(re.search("[\"“”„«»‹›]|(?<!\\w)['‘]|['’](?!\\w)", x) for x in (lower[max(0, found[a].start() - 2) : found[i].start()], lower[found[i].end() : found[b - 1].end() + 2]))
        strength = 0.6**e * (0.25 if marks or set(words[a:b]) & toxicity._REPORTS else 1)
        total += strength
        best[n] = max(best.get(n, 0), strength)
    x = [1, math.log1p(total), math.log1p(1000 * total / max(1, len(words))) / 4, sum(weights[n] * v for n, v in best.items()) / 5]
    return 1 / (1 + math.exp(-sum(p * q for p, q in zip(x, w))))


def test_held_out_rows_are_learned_by_none(spark, docs_of, odd):
    rng = random.Random(2)
    bad, words = ["stupid", "worthless", "pathetic"], [f"word{i}x".replace("0", "o").replace("1", "i") for i in range(200)]
    words = ["".join(rng.choices("aeiourstlnm", k=rng.randint(3, 9))) for _ in range(200)]
    rows, labels = [], []
    for i in range(100, 500):
        toxic = i % 4 == 0
        t = rng.choices(words, k=40)
        if toxic:
            for _ in range(3):
                t[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(t)))
        labels.append((i, int(toxic), 1))
    labels += [(None, 1, 1), (101, None, 1), (100, 1, 1)]
    df = docs_of([*rows, *odd])
    got = {r["doc_id"]: r for r in toxicity.score(df, spark.createDataFrame(labels, "doc_id long, toxic int, quality int")).collect()}
    assert all(r["held_out"] == (d is not None and zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [(r["predicted"], int(d % 4 == 0)) for d, r in got.items() if r["held_out"] and d is not None and d >= 100]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values()) and got[2]["predicted"] == 0
    # other labels of held-out rows change nothing
    turned = [(d, 1 - t if d is not None and t is not None and zlib.crc32(str(d).encode()) % 5 == 0 else t, q) for d, t, q in labels]
    again = {r["doc_id"]: r["score"] for r in toxicity.score(df, spark.createDataFrame(turned, "doc_id long, toxic int, quality int")).collect()}
    assert again == {d: r["score"] for d, r in got.items()}
    # the same scores word by word, and misspelled, quoted and stretched terms in the model that was learned
    model = toxicity.train(df.select("doc_id", "text"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int"))
    text_of = dict(rows)
    assert all(abs(brute_score(model, text_of[d]) - got[d]["score"]) < 1e-5 for d in text_of if d % 7 == 0)
    clean = " ".join(words[:40])
    plain, near, said = (docs_of([(1, f"{clean} {x} {x} {clean}")]) for x in ("stupid", "stupod", 'said "stupid"'))
    matcher = toxicity.Matcher(*model[:3])
    score = lambda d: toxicity.score_of(model, matcher, d.first()["text"])
    assert score(docs_of([(1, f"{clean} {clean}")])) < score(near) < score(plain) and score(said) < score(plain)
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert {r["score"] for r in toxicity.score(df, none).collect()} == {0.0} and toxicity.score(docs_of([]), none).count() == 0
