import os
import random
import re
import time

import pytest

from gridspark.llm import pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- ad --><div class="ad">Buy now</div>
%s
<footer>&copy; us</footer></body></html>"""


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><h1>Head &amp; line</h1><p><b>One  two\n three.<br><p>Short.</p><p>a<b>b</b>c&nbsp;d</p></article>", "Head & line\nOne two three.\nShort.\nab c d".replace("ab c", "abc")),
        ("<article><header><h1>H</h1></header><p>Text.</p><aside>Side</aside><form><input value=x><label>Mail</label></form><div class='share-bar'>Share</div><p>End.</p><section id=comments><p>Nice!</p></section></article><article class=comment><p>Me too, and a long one at that</p></article>", "H\nText.\nEnd."),
        ("<main><p>In main.</p></main><div class='sidebar'><p>Much longer text that stands beside the main text of the page</p></div>", "In main."),
        ("<div id=content><h2>Title of it</h2><p>Some words in a longer line of text, with more words.</p><div class='cookie-notice'>Cookies?</div><p>More.</p></div><div class=comments><p>first! what a nice article you have, thanks a lot for it</p></div>", "Title of it\nSome words in a longer line of text, with more words.\nMore."),
        ("<article><p>Open <p>paragraphs<ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>", "Open\nparagraphs\none\ntwo\nx\ny"),
        ("<article><p>1 < 2 &lt;b&gt; &#233; &eacute; &bogus; a &amp;amp; b</p><!-- <p>gone</p> --><textarea>no</textarea><select><option>no</select></article>", "1 < 2 <b> é é &bogus; a &amp; b"),
    ],
)
def test_layouts(body, text):
    assert pages.main_text(PAGE % body) == text


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><h2 id='related-work'>Related work</h2><p>Of others.</p><div id='discussion'><p>What it means.</p></div><section id='data-sharing'><p>Data.</p></section><div class='comments'><p>Me too</p></div></article>", "Related work\nOf others.\nWhat it means.\nData."),
        ("<article><p>First of two.</p></article><article><p>And the second one, which is longer.</p></article>", "First of two.\nAnd the second one, which is longer."),
        ("<div class='site has-sidebar'><div class='article-header'><h1>The title</h1></div><article><div class='entry-header'><h2>Sub</h2></div><p>Body of the text.</p></article></div>", "Sub\nBody of the text."),
        ("<form action=/><main><p>Wrapped whole in a form.</p></main></form>", "Wrapped whole in a form."),
        ("<article><p class='notice'>We use cookies<p>Text after it.</p><ul><li class='tags'>a, b<li>A point.</ul></article>", "Text after it.\nA point."),
        ("<div><section><div><div><p>A first paragraph of some length, long enough for a surge of its own.</p></div></div></section><section><div><div><p>A second one, after a good deal of nesting.</p></div></div></section></div>", "A first paragraph of some length, long enough for a surge of its own.\nA second one, after a good deal of nesting."),
        ("<div>" + "".join(f"<p><a href=/{i}>Another link of the list number {i}</a></p>" for i in range(9)) + "</div><div><h1>Short</h1><p>By me.</p><p>A paragraph with a number of words in it, enough of them to make a surge.</p></div>", "Short\nBy me.\nA paragraph with a number of words in it, enough of them to make a surge."),
    ],
)
def test_names_and_stretches(body, text):
    assert pages.main_text(PAGE % body) == text


def test_stretches_by_brute_force():
    rng = random.Random(7)
    for _ in range(3000):
        w = [rng.choice([0, 0, 0, 5, 15, 30, 70]) for _ in range(rng.randint(0, 40))]
        heads = [rng.random() < 0.2 for _ in w]
        want, at = [], 0
        while True:
            surge = next((i for i in range(at, len(w)) if w[i] and sum(w[i : i + 3]) >= 60), None)
            if surge is None:
                break
            last = surge
            while any(w[last + 1 : last + 7]):  # fewer than six lines in a row without weight
                last = next(i for i in range(last + 1, last + 7) if w[i])
            solid = surge
            while solid > (want[-1][1] if want else 0) and w[solid - 1]:
                solid -= 1
            want.append((next((i for i in range(solid, surge) if heads[i]), surge), last + 1))
            at = last + 1
        if not want and any(w):
            want = [(min(i for i, x in enumerate(w) if x), max(i for i, x in enumerate(w) if x) + 1)]
        assert pages.stretches(w, heads) == want, (w, heads, want)


def test_the_distribution_decides_without_marks():
    import pyarrow.parquet as pq

    table = "/root/testdata/sf0.01/pages.parquet"
    if not os.path.exists(table):
        pytest.skip("no table of pages here")
    for html in pq.read_table(table, columns=["html"])["html"].to_pylist():
        html = html or ""
        assert pages.main_text(re.sub(r"<(/?)(article|main)\b", r"<\1div", html)) == pages.main_text(html)


def test_broken_markup_takes_linear_time():
    for page in ("<div " * 200_000, '<div "' * 150_000, "<a '>" * 100_000, '<div class="x' * 80_000 + ">", "<" * 1_000_000, "<a <b >" * 100_000, "<p class=ad>" * 60_000):
        began = time.process_time()
        pages.main_text(page)
        assert time.process_time() - began < 6, page[:20]


def test_odd_pages(spark):
    assert pages.main_text("") == "" and pages.main_text("<html><script>x") == "" and pages.main_text("plain words") == "plain words"
    long = "<article>" + "<p>some text</p>" * 20_000 + "</article>"
    assert pages.main_text(long).count("\n") == 19_999
    pages.main_text("<div " * 3000)
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>hi</p>", "x"), (None, "u", "<p>hi</p>", "x")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, pages.extract(df).collect()), key=str) == sorted([(1, "u", "", 0), (2, None, "", 0), (None, "u", "hi", 2), (None, "u", "hi", 2)], key=str)
    assert pages.extract(df.limit(0)).count() == 0
