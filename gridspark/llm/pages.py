"""Main text of web pages by line-block distribution.

Markup is stripped so that every block element gives a line; lines that markup alone makes are left
out. A line weighs its length without its links. Lines of menus, headers, footers, sidebars,
notices, adverts, forms and comments, known by element, role or the whole words of class and id,
weigh nothing. Over the weights a window slides: text begins where the window's sum surges and ends
where it dives to nothing for long; the beginning goes back to a heading right before it. Every such
stretch is kept whole, less the lines beside. Where
article or main mark most of what is left of a page, that is evidence: lines inside weigh enough for
a surge of their own, lines outside weigh nothing. A page without a surge is text as it is.

Names tell nothing about headings, about body, html and main, or about an element that holds the
article or, where none is marked, most of the page's text; of `header` words inside an article they tell nothing either.

Null, empty and textless pages give an empty text. Broken markup is read as far as it goes. Pages
are read whole, in one pass and in time that grows with their length.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Lines under the sliding window; a window's sum that makes a surge, in code points; lines without
#: weight that make a dive.
WINDOW, SURGE, DIVE = 3, 60, 6
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style title textarea noscript template iframe noframes noembed xmp svg math canvas object audio video select datalist button".split())
_AWAY = frozenset("nav aside footer form menu dialog search head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar tablist toolbar status note".split())
#: Words of class and id that name parts of a page beside its article, and words that may stand
#: with them in one name (fixed values).
_NAMES = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer bottombar colophon sidebar aside rail ad ads adv advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments respond disqus reply replies pagination pager tags toolbar widget widgets skip hidden".split())
_NEUTRAL = frozenset("site page main global left right top bottom side sticky fixed primary secondary bar box list section block wrap wrapper container area item items inner outer slot unit links link icons icon buttons button form posts post articles stories panel row column col content tools group thread body text message policy".split())
_NOT = frozenset("has with no without js".split())
_COMMENTS = frozenset("comment comments respond disqus reply replies".split())
_INSIDE = frozenset("header masthead".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ALONE = ("p", "li", "dd", "dt", "td", "th", "tr", "option")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)} if text.strip(" /") else {}


def _named(given: dict[str, str]) -> set[str]:
    """Names of parts beside in class and id: whole words, or words joined with nothing but neutral ones."""
    out: set[str] = set()
    for token in f"{given.get('class', '')} {given.get('id', '')}".split():
        words = re.sub(r"([a-z])([A-Z])", r"\1-\2", token).lower().replace("_", "-").strip("-").split("-")
        if words[0] not in _NOT and all(w in _NAMES or w in _NEUTRAL or w.isdigit() or not w for w in words):
            out.update(w for w in words if w in _NAMES)
    return out


def _beside(name: str, given: dict[str, str], inside: bool) -> str:
    """Whether an element is no part of an article: "" for no; "always"; "unless" it turns out to
    hold the article or most of the text. inside: it stands in an article."""
    if name in _AWAY and name != "form" or name == "header" and not inside:
        return "always"
    if not given:
        return "unless" if name == "form" else ""
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given.get("style", "").lower()):
        return "always"
    if given.get("role", "").lower() in _ROLES:
        return "always"
    if name == "form":
        return "unless"
    if name in ("body", "html", "main") or name in _HEADINGS:
        return ""
    names = _named(given)
    if name == "article" and not inside:
        names &= _COMMENTS
    if inside:
        names -= _INSIDE
    return "always" if names & _COMMENTS else "unless" if names else ""


Line = tuple[str, int, bool, bool, bool]  # text, code points outside links, beside, in an article or main, heading


class _Reader:
    """One pass over a page."""

    def __init__(self, page: str):
        self.page = page
        self.plain = False  # quotes of tags are not minded any more: one was never closed
        self.out: list[tuple[str, int, bool, bool]] = []
        self.held: list[str] = []
        self.linked = 0
        self.links = 0
        self.stack: list[tuple[str, int, bool]] = []  # open containers: name, number of the part beside or -1, article
        self.parts: list[list] = []  # parts beside: first line, end line, "always" or "unless", holds an article

    def tag_end(self, at: int) -> int:
        """The place of the > that ends a tag; quotes hide one, unless they are never closed."""
        page, start = self.page, at
        while not self.plain:
            m = _STOP.search(page, at)
            if not m:
                break
            if m[0] == ">":
                return m.start()
            at = page.find(m[0], m.end()) + 1
            if not at:
                break
        if not self.plain and page.find(">", start) >= 0:
            self.plain = True
        return page.find(">", start)

    def flush(self) -> None:
        text = " ".join(entities.unescape("".join(self.held)).split())
        if text:
            self.out.append((text, max(0, len(text) - self.linked), bool(self.stack) and self.stack[-1][2], bool(self.stack) and self.stack[-1][0] in _HEADINGS))
        self.held.clear()
        self.linked = 0

    def text(self, piece: str) -> None:
        self.held.append(piece)
        if self.links:
            self.linked += len(piece)

    def pop(self, to: int) -> None:
        """Closes containers from number `to` of the stack on."""
        for _, part, _ in self.stack[to:]:
            if part >= 0:
                self.parts[part][1] = len(self.out)
        del self.stack[to:]

    def close(self, name: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == name:
                self.pop(k)
                break

    def open(self, name: str, rest: str) -> None:
        if self.stack and (self.stack[-1][0] == "p" or self.stack[-1][0] == name and name in _ALONE):
            self.pop(len(self.stack) - 1)  # it ends without a tag of its own
        given = _attributes(rest)
        article = bool(self.stack) and self.stack[-1][2]
        how = _beside(name, given, article)
        starts = not how and (name in ("article", "main") or given.get("role", "").lower() in ("main", "article"))
        if how:
            self.parts.append([len(self.out), None, how, False])
        elif name in _ALONE:
            return
        if starts:
            for _, part, _ in self.stack:
                if part >= 0:
                    self.parts[part][3] = True
        self.stack.append((name, len(self.parts) - 1 if how else -1, article or starts))

    def read(self) -> list[Line]:
        page, at, n, lower, opens = self.page, 0, len(self.page), None, True
        while at < n:
            left = page.find("<", at) if opens else -1
            if left < 0:
                self.text(page[at:])
                break
            if left > at:
                self.text(page[at:left])
            if page.startswith("<!--", left):
                end = page.find("-->", left + 4)
                at = n if end < 0 else end + 3
                continue
            if page.startswith(("<!", "<?"), left):
                end = page.find(">", left)
                at = n if end < 0 else end + 1
                continue
            m = _NAME.match(page, left + 1)
            end = self.tag_end(m.end()) if m else -1
            if end < 0:
                opens = not m  # no tag ends from here on
                self.text("<")
                at = left + 1
                continue
            close, name, rest = m[0][0] == "/", m[0].lstrip("/").lower(), page[m.end() : end]
            at = end + 1
            if name == "br" or name == "wbr":
                self.held.append(" " if name == "br" else "")
            elif name == "a":
                self.links = 0 if close else 1
            elif not close and name in _RAW and not rest.rstrip().endswith("/"):
                if lower is None:
                    lower = page.lower()
                    lower = lower if len(lower) == n else "".join(c.lower() if c.isascii() else c for c in page)
                end = lower.find(f"</{name}", at)
                stop = page.find(">", end) if end >= 0 else -1
                at = n if end < 0 or stop < 0 else stop + 1
                if name in _BLOCKS:
                    self.flush()
                elif name in ("select", "button", "textarea", "object", "iframe", "video", "audio", "canvas", "svg", "math"):
                    self.held.append(" ")
            elif name in _BLOCKS:
                self.flush()
                if close:
                    self.links = 0
                    self.close(name)
                elif name not in _VOID:
                    self.open(name, rest)
        self.flush()
        self.pop(0)
        return self.lines()

    def lines(self) -> list[Line]:
        """The lines, those of parts beside marked, less the parts that hold the
        article or, without one, most of the text."""
        upto = [0]
        for text, *_ in self.out:
            upto.append(upto[-1] + len(text))
        edge = [0] * (len(self.out) + 1)
        marked = any(article for _, _, article, _ in self.out)
        for first, end, how, article in self.parts:
            if how == "always" or not article and (marked or 2 * (upto[end] - upto[first]) <= upto[-1]):
                edge[first] += 1
                edge[end] -= 1
        found, depth = [], 0
        for (text, weight, article, heading), step in zip(self.out, edge):
            depth += step
            found.append((text, weight, depth > 0, article, heading))
        return found


def lines(page: str) -> list[Line]:
    """The text of each block in page order."""
    return _Reader(page).read()


def main_text(page: str) -> str:
    """The article's blocks, one to a line."""
    found = lines(page)
    left = sum(len(t) for t, _, beside, *_ in found if not beside)
    marked = sum(len(t) for t, _, beside, article, _ in found if article and not beside)
    evident = 2 * marked >= left > 0
    weights = [0 if beside else max(w, SURGE) if evident and article else 0 if evident else w for _, w, beside, article, _ in found]
    if not evident and not any(weights):  # links alone
        weights = [0 if beside else len(t) for t, _, beside, *_ in found]
    keep = [False] * len(found)
    for start, end in stretches(weights, [x[4] for x in found]):
        keep[start:end] = [True] * (end - start)
    return "\n".join(t for (t, _, beside, article, _), k in zip(found, keep) if k and not beside and (article or not evident))


def stretches(weights: list[int], headings: list[bool]) -> list[tuple[int, int]]:
    """First line and end of each stretch of text: from a surge (a line with weight whose window's sum
    is SURGE or more), or the first heading of the lines with weight right before it, to the last line
    with weight before DIVE lines in a row without any. Without a surge: from the first line
    with weight to the last."""
    n = len(weights)
    total = [0]
    for w in weights:
        total.append(total[-1] + w)
    sums = [total[min(n, i + WINDOW)] - total[i] for i in range(n)]
    out, at = [], 0
    while at < n:
        if weights[at] == 0 or sums[at] < SURGE:
            at += 1
            continue
        last = end = start = at
        while end < n and end - last <= DIVE:
            if weights[end]:
                last = end
            end += 1
        back = at - 1
        while back >= (out[-1][1] if out else 0) and weights[back]:
            start = back if headings[back] else start
            back -= 1
        out.append((start, last + 1))
        at = last + 1
    if not out and total[-1]:
        own = [i for i, w in enumerate(weights) if w]
        out = [(own[0], own[-1] + 1)]
    return out


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages(page_id, url, html). A narrow map."""
    common.ready(pages.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(h) for h in common.texts(b.column(2))]
            yield common.batch(_OUT, {"page_id": b.column(0).to_pylist(), "url": b.column(1).to_pylist(), "text": text, "n_chars": [len(t) for t in text]})

    return common.need(pages, "page_id", "url", "html").mapInArrow(run, common.ddl(_OUT))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
