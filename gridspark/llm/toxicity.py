"""Toxicity scores from a lexicon met by Levenshtein automata, weighed by context.

The lexicon is mined from labelled rows: words and word beginnings that mark toxic documents. All
its terms stand in one trie; the Levenshtein automata of all terms, intersected with that trie,
become one automaton that is made deterministic as words are met. So each word is read once, and
most leave it after a few letters. How many edits a term of its length may be away is looked up
(`allowed`); a term whose near forms turn up in clean labelled rows as well gets none. A hit's
strength is 1, less by NEAR for each edit, and by QUOTED if it is a quotation: quotation marks on
both sides of it, or words of reporting, in a window of words around it. A logistic model over the
sums of strengths gives the score; its weights are not negative, so that a misspelled term raises a
score, less than the term itself, and quoting one lowers it.

Labels are used of rows alone whose crc32(doc_id as text) modulo 5 is not 0, and of TRAIN_ROWS of
them at most, chosen by a hash of doc_id, one row a doc_id. The lexicon made of them has TERMS terms
at most. Neither labels nor lang, source or doc_id are inputs of a score. Rows of labels without a
doc_id or label are skipped; of several for one document the largest counts. Without labelled rows
of both sorts every score is 0. Null and empty texts have no hits and get the model's score for
that. A null doc_id is not held out. Texts and words of any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled rows that the model is fitted on, at most; terms of the lexicon, at most.
TRAIN_ROWS, TERMS, CANDIDATES = 20_000, 400, 4000
#: A term must occur in so many toxic documents, and by so much more often (natural log) in them.
LEAST, ODDS = 3, 1.5
#: Toxic documents count as covered once they hold so many of the terms chosen.
COVER = 4
BEGINNINGS, WINDOW = (4, 5, 6, 7, 8), 6
#: Words kept with what they hit, and their letters at most; other words are looked up each time.
MEMO, MEMO_LETTERS = 400_000, 64
#: A hit's strength for each edit, and in a quotation.
NEAR, QUOTED = 0.6, 0.25
_WORD = re.compile(r"[^\W\d_]+")
_QUOTES = re.compile("[\"“”„«»‹›]|(?<!\\w)['‘]|['’](?!\\w)")
#: Words of reporting, in the languages of the corpus (fixed values).
_REPORTS = frozenset("said says saying quote quoted quotes wrote writes called term word words claimed reported dit disait écrit cité mot mots selon dijo dice escribió citó palabra palabras según sagte sagt schrieb zitierte wort wörter laut".split())


def allowed(term: str) -> int:
    """Edits that a word may be away from a whole-word term."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Matcher:
    """The automaton over a lexicon. Terms that end in * are beginnings. edits: what a term allows."""

    def __init__(self, terms: list[str], weights: list[float] | None = None, edits: list[int] | None = None):
        self.terms = terms
        self.weights = weights or [1.0] * len(terms)
        self.edits = [allowed(t.rstrip("*")) for t in terms] if edits is None else edits
        self.children: list[dict[str, int]] = [{}]
        self.end: list[int] = [-1]
        self.begins: list[int] = [-1]
        self.most: list[int] = [0]
        for t, (term, most) in enumerate(zip(terms, self.edits)):
            node = 0
            self.most[0] = max(self.most[0], most)
            for c in term.rstrip("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.end.append(-1)
                    self.begins.append(-1)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], most)
            (self.begins if term.endswith("*") else self.end)[node] = t
        self.states: dict[tuple, int] = {}
        self.items: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.accept: list[tuple[int, int] | None] = []  # if the word ends here
        self.begun: list[tuple[int, int] | None] = []  # however it goes on
        self.start = self._state({(0): 0})
        self.memo: dict[str, tuple[int, int] | None] = {}

    def _state(self, least: dict[int, int]) -> int:
        """The state of trie nodes with the least edits that reach each; 0 stands for no way out."""
        todo = list(least.items())
        while todo:  # letters of the term that the word lacks
            node, e = todo.pop()
            if least.get(node, 99) < e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.most[child] and e + 1 < least.get(child, 99):
                    least[child] = e + 1
                    todo.append((child, e + 1))
        key = tuple(sorted(least.items()))
        if key not in self.states:
            self.states[key] = len(self.items)
            self.items.append(key)
            self.steps.append({})
            for ends, best in ((self.end, self.accept), (self.begins, self.begun)):
                best.append(min(((e, ends[n]) for n, e in key if ends[n] >= 0 and e <= self.edits[ends[n]]), default=None))
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        out: dict[int, int] = {}
        for node, e in self.items[state]:
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.most[child] and cost < out.get(child, 99):
                    out[child] = cost
            if e + 1 <= self.most[node] and e + 1 < out.get(node, 99):
                out[node] = e + 1
        new = self._state(out) if out else -1
        self.steps[state][c] = new
        return new

    def find(self, word: str) -> tuple[int, int] | None:
        """Edits and term of the nearest term, if any is near enough."""
        state, best = self.start, None
        for c in word:
            nxt = self.steps[state].get(c)
            state = self._step(state, c) if nxt is None else nxt
            if state < 0:
                return best
            begun = self.begun[state]
            if begun is not None and (best is None or begun < best):
                best = begun
                if not best[0]:
                    return best
        whole = self.accept[state]
        return whole if best is None or whole is not None and whole < best else best

    def look(self, word: str) -> tuple[int, int] | None:
        if len(word) > MEMO_LETTERS:
            return self.find(word)
        memo = self.memo
        if word in memo:
            return memo[word]
        if len(memo) > MEMO:
            memo.clear()
        memo[word] = found = self.find(word)
        return found


N_FEATURES = 4


def hits(matcher: Matcher, text: str) -> tuple[int, list[tuple[int, int, bool]]]:
    """The number of words; edits, term and whether it is quoted, of each hit."""
    lower = text.lower()
    words = _WORD.findall(lower)
    look = matcher.look
    hit = {w: f for w in set(words) if (f := look(w)) is not None}
    if not hit:
        return len(words), []
    spans = [m.span() for m in _WORD.finditer(lower)]
    out = []
    for i, w in enumerate(words):
        f = hit.get(w)
        if f is None:
            continue
        a, b = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
        quoted = any(x in _REPORTS for x in words[a:b])
        if not quoted:
            before, after = lower[max(0, spans[a][0] - 2) : spans[i][0]], lower[spans[i][1] : spans[b - 1][1] + 2]
            quoted = bool(_QUOTES.search(before)) and bool(_QUOTES.search(after))
        out.append((*f, quoted))
    return len(words), out


def features(matcher: Matcher, text: str) -> list[float]:
    """Bias, strength of all hits, strength for a thousand words, and the odds of the different terms
    by the strongest hit of each."""
    n, found = hits(matcher, text)
    if not found:
        return [1.0, 0.0, 0.0, 0.0]
    total, best = 0.0, {}
    for edits, term, quoted in found:
        strength = NEAR**edits * (QUOTED if quoted else 1.0)
        total += strength
        best[term] = max(best.get(term, 0.0), strength)
    return [1.0, math.log1p(total), math.log1p(1000 * total / n) / 4, sum(matcher.weights[t] * x for t, x in best.items()) / 5]


def fit_upwards(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """`fit` without negative weights but for the bias: features that want one are left out."""
    use = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(x.shape[1])
        w[use] = fit(x[:, use], y)
        wrong = w[1:] < 0
        if not wrong.any():
            return w
        use[1:] &= ~wrong


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Ridge-penalized logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _terms_of(text: str) -> set[str]:
    words = {w for w in _WORD.findall(text.lower()) if 3 < len(w) <= 32}
    return words | {w[:k] + "*" for w in words for k in BEGINNINGS if len(w) > k}


_COUNTS = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])


def mine(sample: DataFrame) -> list[tuple[str, float]]:
    """The lexicon: terms, with their log odds, that between them cover the toxic documents."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic: Counter = Counter()
            clean: Counter = Counter()
            for text, label in zip(common.texts(b.column(0)), b.column(1).to_pylist()):
                (toxic if label else clean).update(_terms_of(text))
            terms = list(toxic | clean)
            yield common.batch(_COUNTS, {"term": terms, "toxic": [toxic[t] for t in terms], "clean": [clean[t] for t in terms]})

    sizes = {r[0]: r[1] for r in sample.groupBy("label").agg(F.count("*")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return []
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
    counted = sample.select("text", "label").mapInArrow(count, common.ddl(_COUNTS)).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    best = counted.where(F.col("toxic") >= LEAST).withColumn("odds", odds).where(F.col("odds") >= ODDS).withColumn("rank", F.col("odds") * F.sqrt("toxic"))
    found = best.orderBy(F.desc("rank"), F.col("term").endswith("*"), F.length("term").desc(), "term").limit(CANDIDATES).collect()
    number = {r["term"]: i for i, r in enumerate(found)}

    def holds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [sorted(number[t] for t in _terms_of(x) if t in number) for x in common.texts(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int64()))], names=["terms"])

    docs = [set(r[0]) for r in sample.where("label = 1").select("text").mapInArrow(holds, "terms array<bigint>").collect()]
    inside: dict[int, list[int]] = {}
    for d, terms in enumerate(docs):
        for t in terms:
            inside.setdefault(t, []).append(d)
    need = np.full(len(docs), COVER)
    chosen: list[str] = []
    odds_of = {r["term"]: float(r["odds"]) for r in found}
    taken: dict[str, set[int]] = {}
    for i, r in enumerate(found):
        own = inside.get(i, [])
        same = frozenset(own)
        if any(r["term"].rstrip("*").startswith(c.rstrip("*")) and c.endswith("*") or same == frozenset(taken[c]) and c.startswith(r["term"].rstrip("*")) for c in chosen):
            continue  # a chosen beginning covers it, or it is the beginning of a chosen equal
        if sum(need[d] > 0 for d in own) >= LEAST:
            chosen.append(r["term"])
            taken[r["term"]] = set(own)
            need[own] -= 1
        if len(chosen) == TERMS or not (need > 0).any():
            break
    return [(t, odds_of[t]) for t in chosen]


def near_edits(sample: DataFrame, terms: list[str]) -> list[int]:
    """Edits that each term allows: none if its near forms occur in LEAST clean rows or more, and not
    by ODDS more often in toxic ones."""

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms)
        for b in batches:
            out: tuple[list, list] = ([], [])
            for text, label in zip(common.texts(b.column(0)), b.column(1).to_pylist()):
                own = {t for e, t, _ in hits(matcher, text)[1] if e}
                out[0].extend(own)
                out[1].extend([label] * len(own))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["term", "label"])

    sizes = {r[0]: r[1] for r in sample.groupBy("label").agg(F.count("*")).collect()}
    counted = sample.select("text", "label").mapInArrow(near, "term bigint, label bigint").groupBy("term").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    edits = [allowed(t.rstrip("*")) for t in terms]
    for r in counted.collect():  # a row a term
        odds = math.log((r["toxic"] + 0.5) / (sizes[1] + 1)) - math.log((r["clean"] + 0.5) / (sizes[0] + 1))
        if r["clean"] >= LEAST and odds < ODDS:
            edits[r["term"]] = 0
    return edits


def train(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[float], list[int], np.ndarray] | None:
    """The lexicon, its terms' odds and edits, and the model's weights, from TRAIN_ROWS labelled rows at most."""
    spark = docs.sparkSession
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    picked = one.where(~_held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    rows = [(r[0], int(r[1] > 0)) for r in picked.collect()]
    if not rows:
        return None
    bounded = F.broadcast(spark.createDataFrame(rows, "doc_id long, label int"))  # TRAIN_ROWS rows at most
    # of several rows of a doc_id the one of the least text: no more than TRAIN_ROWS rows come together
    sample = common.written(docs.select("doc_id", "text").join(bounded, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")))
    mined = mine(sample)
    if not mined:
        return None
    terms, weights = [t for t, _ in mined], [w for _, w in mined]
    edits = near_edits(sample, terms)

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms, weights, edits)
        for b in batches:
            x = [features(matcher, t) for t in common.texts(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1).cast(pa.int64())], names=["x", "y"])

    got = sample.select("text", "label").mapInArrow(measure, "x array<double>, y bigint").collect()
    return terms, weights, edits, fit_upwards(np.array([r[0] for r in got]), np.array([r[1] for r in got], float))


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score_of(model: tuple, matcher: Matcher, text: str) -> float:
    return round(float(1 / (1 + np.exp(-np.clip(np.dot(features(matcher, text), model[3]), -30, 30)))), 6)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs(doc_id, text); labels(doc_id, toxic)."""
    spark = common.ready(docs.sparkSession)
    docs = common.need(docs, "doc_id", "text")
    model = train(docs, common.need(labels, "doc_id", "toxic"))
    shared = spark.sparkContext.broadcast(model)  # TERMS terms at most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        matcher = Matcher(*model[:3]) if model else None
        for b in batches:
            p = [score_of(model, matcher, t) if model else 0.0 for t in common.texts(b.column(1))]
            yield common.batch(_OUT, {"doc_id": b.column(0).to_pylist(), "held_out": b.column(2).to_pylist(), "score": p, "predicted": [int(x >= 0.5) for x in p]})

    return docs.withColumn("_held", _held_out()).mapInArrow(run, common.ddl(_OUT))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")
