import collections
import random
import re

from gridspark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    w = WORD.findall(text or "")
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    inside = {j for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w)


def test_measures_and_verdicts(spark, docs_of, odd):
    random.seed(2)
    words = [f"w{i}" for i in range(60)]
    rows = [*odd, *((100 + i, "\n".join(" ".join(random.choices(words, k=random.randint(1, 30))) for _ in range(8))) for i in range(150)), *((400 + i, " ".join(f"{w}***" for w in random.sample(words, 60))) for i in range(5)), (500, "a b c a b c\nx y\nx y")]
    df = docs_of(rows)
    got = quality.judge(df).collect()
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((tuple(r[n] for n in names) for r in got), key=str) == sorted(((d, *measured(t)) for d, t in rows), key=str)
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert not any(r["kept"] and r["base_failed"] for r in got) and not kept & {400, 401, 402, 403, 404}
    clean = {d for d, t in rows if d and 100 <= d < 400 and not measured(t)[-1]}
    assert len(clean - kept) <= len(clean) // 50
    out = quality.keep(df)
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == kept
    assert quality.judge(docs_of([])).count() == 0 and quality.keep(docs_of([])).count() == 0


def test_sketches_merge_and_bound_quantiles(spark):
    rows = [(i, "en", f"s{i % 3}", 1000, 5000, int(x), 0, 0, 10, False) for i, x in enumerate(random.Random(5).choices(range(1, 2000), k=600))]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, base_failed boolean")
    fine = quality.sketches(df, ["lang", "source"])
    merged = {r["measure"]: r for r in quality.quartiles(quality.merge(fine, ["lang"]), ["lang"]).collect()}
    values = sorted(r[5] / 1000 for r in rows)
    r = merged["symbol_ratio"]
    assert r["size"] == 600
    for q, share in (("q1", 0.25), ("q3", 0.75)):
        true = values[int(share * 600 + 0.5) - 1]
        assert abs(r[q] - true) <= 2 * quality.ACCURACY * true + 1e-9


def test_limits_follow_the_groups(spark):
    rng = random.Random(8)
    # per 1,000 words: source a has few symbols and short, uniform words; b many symbols and longer, varied ones
    rows = [(i, "en", "a", 1000, 4500 + rng.randint(-50, 50), rng.choice([0, 0, 0, 20]), 0, 0, 10, False) for i in range(1000)]
    rows += [(1000 + i, "en", "b", 1000, 6000 + rng.randint(-300, 300), rng.choice([0, 0, 0, 400]), 0, rng.choice([0] * 9 + [100]), 10, False) for i in range(1000)]
    # alike but for the source
    rows += [(5000, "en", "a", 1000, 4500, 300, 0, 0, 10, False), (5001, "en", "b", 1000, 6000, 300, 0, 0, 10, False), (5002, "en", "a", 1000, 5600, 0, 0, 0, 10, False)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, base_failed boolean")
    given = quality.limits(df)
    a, b = given.orderBy("_source").collect()
    assert a["_symbol_ratio_high"] < 0.1 < 0.3 < b["_symbol_ratio_high"] and a["_repeat_ratio_high"] < b["_repeat_ratio_high"]
    width = [r["_word_length_high"] - r["_word_length_low"] for r in (a, b)]
    assert width[0] < 0.8 * width[1]
    kept = {r["doc_id"]: r["kept"] for r in quality.verdicts(df, given).collect()}
    assert (kept[5000], kept[5001], kept[5002]) == (False, True, False)
    assert sum(not kept[i] for i in range(2000)) <= 40
