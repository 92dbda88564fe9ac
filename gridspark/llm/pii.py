"""Personal data: fixed patterns, and a linear-chain conditional random field that adds spans.

The base spans of each kind are those of its pattern, leftmost and not overlapping, less those
that fail the kind's check. The field labels tokens by features of their shapes and adds spans
that overlap no base span: numbers in local notation, addresses written out in words. Tokens
further than REACH from a digit, an @ or the word "dot" have the label O by the model's definition;
so the chain falls into windows that can be decoded apart, with O on either side, and the result is
that of decoding the whole text. The field is trained, when first used, on a small labelled table
that the rules of `labelled` spell out, and decoded by Viterbi over numpy batches of many windows.
Its parameters are a fixed few hundred KB, whatever the data.

Null texts count as empty and have no spans; so do empty texts. Repeated rows repeat. Texts of
any length are read whole, in time that grows with their length. Positions are code points, ends
exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind as listed, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Digits that follow a digit can't begin a match that did not begin before; so each start is tried once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]").search


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """By start, then kind as listed."""
    out: list[Span] = []
    if not _SIGN(text):
        return out
    out += [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) < 4 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# --- the field -----------------------------------------------------------------------------

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_")
_TRIGGER = re.compile(r"[0-9@]|\b[dD][oO][tT]\b")
#: Code points on either side of a trigger that its window takes in, before it grows to white space.
REACH = 48
_CUES = {w: c for c, ws in {"tel": "tel phone telephone call mobile cell fax telefon tél teléfono", "mail": "mail email e-mail write contact", "card": "card visa mastercard amex credit carte karte tarjeta", "ip": "ip host server address", "at": "at", "dot": "dot", "tld": "com org net edu de fr es io", "num": "version v section page chapter year price token password key id isbn order no"}.items() for w in ws.split()}


def _shape(t: str) -> str:
    if t.isdecimal():
        return f"9{min(len(t), 7)}"
    if t.isalpha():
        cue = _CUES.get(t.lower())
        case = "a" if t.islower() else "A" if t.isupper() else "Aa"
        return f"={cue}" if cue else f"{case}{min(len(t), 3) if len(t) < 4 else ''}"
    return t


#: Features of a token; what may stand between the groups of one number, and how much of it.
WIDTH, _JOINS, _BETWEEN = 13, frozenset(" ().-/_[]+"), 3


def _runs(found: list[str]) -> list[tuple[str, str, int]]:
    """For each token of a run of digit groups the lengths of the groups, a coarser form of them and
    the token's place in the run; the separator does not matter. Others have empty ones."""
    out = [("", "", 0)] * len(found)
    i = 0
    while i < len(found):
        if not found[i].isdecimal():
            i += 1
            continue
        end, groups, t = i + 1, [i], i + 1
        while t < len(found) and t - end <= _BETWEEN and (found[t].isdecimal() or found[t] in _JOINS):
            if found[t].isdecimal():
                groups.append(t)
                end = t + 1
            t += 1
        sizes = [len(found[g]) for g in groups]
        shape = "-".join(map(str, sizes)) if len(groups) < 7 else "many"
        coarse = f"{min(len(groups), 7)}{'s' if max(sizes) < 4 else ''}/{min(sum(sizes), 20)}"
        k = 0
        for t in range(i, end):
            k += t in groups
            out[t] = (shape, coarse, min(k, 7) * 2 + (t in groups))
        i = end
    return out


def features(text: str) -> tuple[list[tuple[int, int]], list[list[str]]]:
    """Places of the tokens and the word-shape features of each."""
    found = list(_TOKEN.finditer(text))
    places = [m.span() for m in found]
    shapes = ["<", "<", *(_shape(m[0]) for m in found), ">", ">"]
    gaps = ["g", "g", *("g" if i == 0 or places[i - 1][1] < a else "" for i, (a, _) in enumerate(places)), "g", "g", "g"]
    out = []
    runs = _runs([m[0] for m in found])
    for i in range(len(places)):
        k = i + 2
        shape, coarse, at = runs[i]
        a, b, c, d, e = shapes[k - 2 : k + 3]
        gb, gd, ge = gaps[k], gaps[k + 1], gaps[k + 2]
        out.append([f"0{c}", f"-1{b}{gb}", f"+1{gd}{d}", f"-2{a}", f"+2{e}", f"b{b}{gb}{c}", f"a{c}{gd}{d}", f"t{b}{gb}{c}{gd}{d}", f"p{a}{gaps[k - 1]}{b}{gb}{c}", f"n{c}{gd}{d}{ge}{e}", f"R{shape}#{at}", f"G{coarse}#{at}", f"H{coarse}{c}"])
    return places, out


def _makers(r: random.Random) -> tuple[list, list, list]:
    """Rules for values with a kind, the same for forms that training never sees, and for values of no kind."""
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice(["an", "the", "or", "ing", "so", "ver", "el", "mi", "ta", "ou"]) for _ in range(r.randint(1, 3)))
    tld = lambda: r.choice(["com", "org", "net", "de", "fr", "es", "io"])
    octets = lambda: [str(r.randint(0, 255)) for _ in range(4)]

    def card(join: str) -> str:
        body = r.choice("3456") + d(14)
        whole = next(body + c for c in "0123456789" if _luhn(body + c))
        return join.join(whole[i : i + 4] for i in range(0, 16, 4)) if join else whole

    taught = [
        (0, lambda: f"{word()}.{d(2)}@{word()}{d(1)}.example.{tld()}"),
        (0, lambda: f"{word()}@{word()}.{tld()}"),
        (0, lambda: f"{word()} at {word()} dot {tld()}"),
        (0, lambda: f"{word()}.{word()} at {word()} dot {tld()}"),
        (0, lambda: f"{word()} [at] {word()} [dot] {tld()}"),
        (0, lambda: f"{word()}(at){word()}(dot){tld()}"),
        (0, lambda: f"{word()} (at) {word()} (dot) {tld()}"),
        (1, lambda: ".".join(octets())), (1, lambda: " . ".join(octets())), (1, lambda: "[.]".join(octets())), (1, lambda: " dot ".join(octets())),
        (2, lambda: card("")), (2, lambda: card(" ")), (2, lambda: card("-")), (2, lambda: card("/")), (2, lambda: card("  ")),
        (3, lambda: f"+{r.randint(1, 9)} ({d(3)}) {d(3)}-{d(4)}"), (3, lambda: f"({d(3)}) {d(3)}-{d(4)}"), (3, lambda: f"({d(3)}) {d(3)} {d(4)}"), (3, lambda: f"{d(3)}-{d(3)}-{d(4)}"), (3, lambda: f"{d(3)} {d(3)} {d(4)}"),
        (3, lambda: f"00{d(2)} {d(3)} {d(3)} {d(4)}"), (3, lambda: f"+{d(2)} {d(3)} {d(7)}"), (3, lambda: f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}"),
    ]
    held = [
        (0, lambda: f"{word()} [at] {word()} dot {tld()}"), (0, lambda: f"{word()}@{word()} dot {tld()}"), (0, lambda: f"{word()}.{word()} (at) {word()} dot {tld()}"),
        (1, lambda: "(.)".join(octets())), (1, lambda: " [.] ".join(octets())),
        (2, lambda: card(".")), (2, lambda: card("_")),
        (3, lambda: f"{d(3)}.{d(3)}.{d(4)}"), (3, lambda: f"({d(3)}) {d(3)}.{d(4)}"), (3, lambda: f"({d(3)})-{d(3)}-{d(4)}"), (3, lambda: f"0{d(1)}-{d(2)}-{d(2)}-{d(2)}-{d(2)}"),
    ]
    none = [
        lambda: f"version {r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 20)}", lambda: f"CC BY-NC {r.randint(1, 4)}.0.", lambda: f"Version {r.randint(1, 4)}.{d(1)}", lambda: f"in {r.randint(1900, 2030)}", lambda: f"{r.randint(1900, 2030)}, {r.randint(1900, 2030)}",
        lambda: f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1990, 2030)}", lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"{r.randint(1, 12)}:{d(2)}", lambda: f"${r.randint(1, 999)}.{d(2)}", lambda: f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}",
        lambda: f"{r.randint(1, 999)},{d(3)},{d(3)}", lambda: "AKIA" + "".join(r.choice("ABCDEFGHJKLMNP23456789") for _ in range(16)), lambda: 'token = "' + "".join(r.choice("abcdef0123456789") for _ in range(40)) + '"',
        lambda: "password=" + "".join(r.choice("abcdef0123456789") for _ in range(18)), lambda: f"connect the dot to {word()}", lambda: f"the dot {word()} at {word()}", lambda: f"order no {d(7)}", lambda: f"pages {d(2)}-{d(3)}", lambda: f"{d(2)}.{d(2)}", lambda: f"@{word()}", lambda: f"{word()} @ {word()}", lambda: f"ISBN 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
        lambda: f"{d(1)} {d(2)} {d(1)} {d(3)}", lambda: f"at {word()} {d(2)}", lambda: d(r.randint(1, 13)), lambda: f"{d(2)} {d(4)}", lambda: f"({d(1)}) {word()} ({d(2)})", lambda: f"{word()}{d(2)}", lambda: f"https://{word()}.{tld()}/{d(3)}/{word()}", lambda: f"{d(3)}%%% {word()}### {d(2)}***", lambda: " ".join(d(2) for _ in range(r.randint(2, 9))), lambda: ", ".join(d(3) for _ in range(r.randint(2, 6))),
    ]
    return taught, held, none


def prose_word(r: random.Random) -> str:
    out = "".join(r.choice(["an", "the", "or", "ing", "so", "ver", "el", "mi", "ta", "ou", "é", "ción", "ß", "ich", "a", "tion"]) for _ in range(r.choice([1, 1, 2, 2, 3, 4])))
    return out.capitalize() if r.random() < 0.12 else out.upper() if r.random() < 0.02 else out


def prose(r: random.Random, most: int) -> str:
    """Up to `most` words of ordinary text, with its punctuation, now and then with marks on every word."""
    mark = r.random() < 0.1
    return " ".join(prose_word(r) + (r.choice(["###", "%%%", "***", "$$$", "&&&"]) if mark else r.choice(["", "", "", "", "", "", ",", ".", ";", ":", "!", " |", ")", "?"])) for _ in range(r.randint(0, most)))


def sentence(r: random.Random, kind: int | None, value: str) -> tuple[str, list[Span]]:
    """The value in prose, behind a word that leads to it or none."""
    lead = {0: ["write to", "mail", "contact", "", "", ""], 1: ["host", "from", "server at", "", "", ""], 2: ["card", "visa", "paid by", "", "", ""], 3: ["tel", "call", "phone", "", "", ""], None: [""]}
    before = f"{prose(r, 9)} {r.choice(lead[kind])}".strip()
    start = len(before) + 1 if before else 0
    text = (f"{before} {value}" if before else value) + r.choice([" ", " ", " ", ". ", ", ", "; ", "### ", "!! ", " | ", ") "]) + prose(r, 9)
    return text, [] if kind is None else [(start, kind, start + len(value))]


def labelled(seed: int = 7, copies: int = 10, held: bool = False) -> list[tuple[str, list[Span]]]:
    """The small labelled table: sentences with the spans in them, and hard sentences without."""
    r = random.Random(seed)
    taught, kept, none = _makers(r)
    out = []
    for _ in range(copies):
        out += [sentence(r, kind, make()) for kind, make in (kept if held else taught)]
        out += [sentence(r, None, make()) for make in none]
    return out


class Field:
    """Weights of a linear-chain conditional random field."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.index, self.emit, self.move = index, emit, move
        #: An inside label may only follow its own kind's labels; nothing else is forbidden.
        self.barred = np.zeros_like(move)
        for j, name in enumerate(LABELS):
            if name[0] == "I":
                self.barred[:, j] = [0 if a[1:] == name[1:] else -1e9 for a in LABELS]

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        get = self.index.get
        ids = np.array([[get(f, 0) for f in row] for row in rows], np.int64).reshape(-1, WIDTH)
        return self.emit[ids].sum(axis=1)

    def viterbi(self, padded: np.ndarray, lengths: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
        """Best labels of a batch (windows, tokens, labels), all windows at once. ends: whether a
        window is the text's beginning, and its end (both, if not given); elsewhere its neighbours are
        labelled O."""
        n, most, k = padded.shape
        ends = np.ones((n, 2), bool) if ends is None else ends
        move = self.move + self.barred
        best = padded[:, 0] + np.array([-1e9 if x[0] == "I" else 0.0 for x in LABELS]) + np.where(ends[:, :1], 0.0, move[0][None])
        back = np.zeros((n, most, k), np.int8)
        for t in range(1, most):
            through = best[:, :, None] + move[None]
            pick = through.argmax(axis=1)
            value = np.take_along_axis(through, pick[:, None], axis=1)[:, 0] + padded[:, t]
            on = (t < lengths)[:, None]
            back[:, t] = np.where(on, pick, np.arange(k))
            best = np.where(on, value, best)
        out = np.zeros((n, most), np.int8)
        at = (best + np.where(ends[:, 1:], 0.0, move[:, 0][None])).argmax(axis=1)
        for t in range(most - 1, -1, -1):
            out[:, t] = at
            at = back[np.arange(n), t, at]
        return out


def train(table: list[tuple[str, list[Span]]], rounds: int = 60, rate: float = 0.4, decay: float = 1e-3, least: int = 2) -> Field:
    """Maximum likelihood by AdaGrad, all sentences in each step, forward and backward in numpy."""
    data = []
    seen: dict[str, int] = {}
    for text, spans in table:
        places, rows = features(text)
        labels = [0] * len(places)
        for start, kind, end in spans:
            own = [i for i, (a, b) in enumerate(places) if a >= start and b <= end]
            for i in own:
                labels[i] = 1 + 2 * kind + (i != own[0])
        data.append((rows, labels))
        for f in {f for row in rows for f in row}:
            seen[f] = seen.get(f, 0) + 1
    index = {f: i + 1 for i, f in enumerate(sorted(f for f, n in seen.items() if n >= least))}
    data = [x for x in data if x[0]]
    n, most, k = len(data), max(len(x[0]) for x in data), len(LABELS)
    ids = np.zeros((n, most, WIDTH), np.int64)
    gold, on = np.zeros((n, most), np.int64), np.zeros((n, most), bool)
    for i, (rows, labels) in enumerate(data):
        ids[i, : len(rows)] = [[index.get(f, 0) for f in row] for row in rows]
        gold[i, : len(rows)], on[i, : len(rows)] = labels, True
    emit, move = np.zeros((len(index) + 1, k)), np.zeros((k, k))
    square_e, square_m = np.full_like(emit, 1e-8), np.full_like(move, 1e-8)
    mask = on.reshape(-1)
    flat = ids.reshape(-1, WIDTH)[mask]
    order = np.argsort(flat, axis=None, kind="stable")  # tokens by feature, so that a feature's sum is one stretch
    present, begin = np.unique(flat.reshape(-1)[order], return_index=True)
    token = order // WIDTH
    for _ in range(rounds):
        s = np.zeros((n, most, k))
        s[on] = emit[flat].sum(axis=1)
        forward, backward = np.zeros_like(s), np.zeros_like(s)
        forward[:, 0] = s[:, 0]
        total = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
        for t in range(1, most):
            step = total(forward[:, t - 1][:, :, None] + move[None], 1) + s[:, t]
            forward[:, t] = np.where(on[:, t, None], step, forward[:, t - 1])
        for t in range(most - 2, -1, -1):
            step = total(move[None] + (s[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(on[:, t + 1, None], step, 0)
        z = total(forward[:, -1], 1)
        node = np.exp(forward + backward - z[:, None, None]) * on[:, :, None]
        node[np.arange(n)[:, None], np.arange(most)[None], gold] -= on
        grad_e = np.zeros_like(emit)
        wrong = node.reshape(-1, k)[mask]
        grad_e[present] = np.add.reduceat(wrong[token], begin, axis=0)
        grad_m = np.zeros_like(move)
        for t in range(1, most):
            live = on[:, t]
            pair = np.exp(forward[live, t - 1][:, :, None] + move[None] + (s[live, t] + backward[live, t])[:, None, :] - z[live, None, None])
            grad_m += pair.sum(axis=0)
            np.add.at(grad_m, (gold[live, t - 1], gold[live, t]), -1.0)
        for w, g, q in ((emit, grad_e / n, square_e), (move, grad_m / n, square_m)):
            g = g + decay / n * w
            q += g * g
            w -= rate * g / np.sqrt(q)
        emit[0] = 0
    return Field(index, emit, move)


_TRAINED: dict = {}


def field() -> Field:
    """Trained once a process, the same every time."""
    if "field" not in _TRAINED:
        _TRAINED["field"] = train(labelled())
    return _TRAINED["field"]


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches of whole words around triggers, apart from each other: the tokens that may have
    another label than O."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        b = m.end() + REACH
        if out and m.start() - REACH <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([max(0, m.start() - REACH), b])
    for w in out:  # to white space on either side
        a, b = w[0], min(w[1], len(text))
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        w[:] = [a, b]
    joined: list[list[int]] = []
    for w in out:  # what touches now is one
        if joined and not text[joined[-1][1] : w[0]].strip():
            joined[-1][1] = w[1]
        elif joined and w[0] < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], w[1])
        else:
            joined.append(w)
    return [(a, b) for a, b in joined if a < b]


def _around(text: str, a: int, b: int) -> tuple[int, int]:
    """a and b moved out by two stretches without white space, which hold two tokens at least."""
    for _ in range(2):
        while a > 0 and text[a - 1].isspace():
            a -= 1
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and text[b].isspace():
            b += 1
        while b < len(text) and not text[b].isspace():
            b += 1
    return a, b


def field_spans(model: Field, texts: list[str], cells: int = 60_000) -> list[list[Span]]:
    """The field's spans of each text, in order; windows of like length are decoded together."""
    todo = []
    for i, text in enumerate(texts):
        for a, b in windows(text):
            left, right = _around(text, a, b)
            places, rows = features(text[left:right])
            own = [t for t, (x, _) in enumerate(places) if a <= left + x < b]
            if own:
                first, last = own[0], own[-1] + 1
                ends = (left == 0 and first == 0, right == len(text) and last == len(places))
                todo.append((len(own), i, left, places[first:last], rows[first:last], ends))
    todo.sort(key=lambda x: x[0])
    found: list[list[Span]] = [[] for _ in texts]
    at = 0
    while at < len(todo):
        end = at + 1
        while end < len(todo) and todo[end][0] * (end + 1 - at) <= cells:
            end += 1
        group = todo[at:end]
        at = end
        lengths = np.array([g[0] for g in group])
        padded = np.zeros((len(group), int(lengths.max()), len(LABELS)))
        scores = model.scores([row for g in group for row in g[4]])
        padded[np.arange(padded.shape[1])[None] < lengths[:, None]] = scores
        labels = model.viterbi(padded, lengths, np.array([g[5] for g in group]))
        for row, (n, i, a, places, _, _) in zip(labels, group):
            found[i] += spans_of(row[:n].tolist(), [(a + x, a + y) for x, y in places])
    return [sorted(x) for x in found]


def spans_of(labels: list[int], places: list[tuple[int, int]]) -> list[Span]:
    """The spans that labels mark: a B label, or an I label's first, begins one; O and B end one."""
    out, start = [], None
    for t in range(len(labels) + 1):
        label = labels[t] if t < len(labels) else 0
        if start is not None and (label == 0 or label % 2 == 1):
            out.append((places[start][0], (labels[start] - 1) // 2, places[t - 1][1]))
            start = None
        if label % 2 == 1:
            start = t
    return out


def _plausible(text: str, kind: int) -> bool:
    """What a span of the field must hold to count as one of its kind."""
    digits = re.sub(r"\D", "", text)
    if kind == 0:
        return bool(re.search(r"@|\bat\b", text, re.I)) and bool(re.search(r"\.|\bdot\b", text, re.I))
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) < 4 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 14 <= len(digits) <= 19 and _luhn(digits)
    return 9 <= len(digits) <= 15


def spans(model: Field, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans and all its spans, both by start, then kind."""
    out = []
    for text, extra in zip(texts, field_spans(model, texts)):
        base = base_spans(text)
        taken = list(base)
        for start, kind, end in sorted(extra):
            if _plausible(text[start:end], kind) and all(end <= a or start >= b for a, _, b in taken):
                taken.append((start, kind, end))
        out.append((base, sorted(taken)))
    return out


def written(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def redacted(text: str, found: list[Span]) -> str:
    """The text with each span (overlapping ones as one) replaced by its first kind in capitals."""
    out, done = [], 0
    for a, k, b in found:
        if a >= done:
            out += [text[done:a], f"<{KINDS[k].upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


_OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])


def _model(shared) -> Field:  # noqa: ANN001
    if "pii" not in common.WORKER:
        common.WORKER["pii"] = shared.value
    return common.WORKER["pii"]


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, the numbers of base spans by kind, base_sha256, spans (base and added), n_added."""
    spark = common.ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(field())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        for b in batches:
            out: dict = {f.name: [] for f in _OUT}
            out["doc_id"] = b.column(0).to_pylist()
            for base, every in spans(model, common.texts(b.column(1))):
                for k, name in enumerate(KINDS):
                    out[f"n_{name}"].append(sum(x[1] == k for x in base))
                out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
                out["spans"].append(written(every))
                out["n_added"].append(len(every) - len(base))
            yield common.batch(_OUT, out)

    return common.need(docs, "doc_id", "text").mapInArrow(run, common.ddl(_OUT))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced, and n_chars to match if there is such a column.
    Null texts stay null; other columns stay as they are."""
    spark = common.ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(field())
    names = docs.columns
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared)
        for b in batches:
            texts = b.column(at).to_pylist()
            new = [None if t is None else redacted(t, every) for t, (_, every) in zip(texts, spans(model, [t or "" for t in texts]))]
            columns = list(b.columns)
            columns[at] = pa.array(new, columns[at].type)
            if count is not None:
                columns[count] = pa.array([None if t is None else len(t) for t in new], columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(common.table(spark, sf_dir, "documents"))
