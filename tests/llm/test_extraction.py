"""Extraction: blocks of odd pages, decoding against all labelings, held-out layouts, pages by hand, and the query against the tables' one layout."""

import html
import itertools
import re
import time

import numpy as np
import pytest

from brightwater.llm import extraction
from brightwater.llm.page_blocks import Elements, leaf_blocks
from brightwater.llm.page_layouts import labelled_pages
from brightwater.llm.queries import op13_extraction

from .pages import PAGES

SF = "/root/testdata/sf0.001"


def texts(page):
    return [b.text for b in leaf_blocks(page, Elements())]


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("", []), ("  plain &amp; text\n here", ["plain & text here"]), ("<p>a<p>b<br>c</p>d", ["a", "b c", "d"]), ("<ul><li>a<li>b<ul><li>c</ul>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<div>a<b>b</b>c<p>d</div>e", ["abc", "d", "e"]), ("<p>x &lt;y&gt; &eacute;&nbsp;&#x41;&#66; &copy z</p>", ["x <y> é AB © z"]), ("a<script>if (a<b) '<p>no'</script>b<style>p{}</style>c", ["abc"]),
        ("<SCRIPT>x</Script >y", ["y"]), ("a<script>never closed <p>b", ["a"]), ("a<!-- <p>x</p> -->b<!-->c<!---->d<!--open <p>e", ["abcd"]), ("<!DOCTYPE html><?xml x?><p>a</ >b", ["ab"]),
        ("1 < 2 and 3 > 2 <3", ["1 < 2 and 3 > 2 <3"]), ('<p title="a>b">c<a href=x>d', ["cd"]), ("<p title='>' x=\">\">c", ["c"]), ("a <b cut off", ["a"]), ("<select><option>a</select>b<button>c</button>d<noscript><p>e</noscript>f", ["bdf"]),
        ("<table><tr><td>a<td>b<tr><th>c</table>d", ["a", "b", "c", "d"]), ("<dl><dt>a<dd>b<dt>c</dl>", ["a", "b", "c"]), ("<h1>a<h2>b</h2>", ["a", "b"]), ("<x-card>a</x-card>b<svg><text>no</text></svg>", ["a", "b"]),
        ("<template><p>a</template><title>t</title><textarea><p>b</textarea>c", ["c"]), ("<p>a</b></i></div>b", ["a", "b"]), ("<a>x<a>y</a>z", ["xyz"]), ("\ud800 <p>\x00b", ["\ud800", "\x00b"]),
    ],
)
def test_blocks(page, blocks):
    assert texts(page) == blocks


def test_elements_and_links():
    (a, b) = leaf_blocks('<body class="no"><DIV class="Site-navBar" ID=top><p>x<b>y</div><div data-label=main><p>one <a href=1>two</a>', Elements())
    assert a.element.tag == "p" and a.element.parent.names == "Site-navBar top" and a.linked == 0
    assert {"t:div", "w:nav", "w:bar", "w:top", "x:site"} <= extraction.element_features(a.element) and "w:no" not in extraction.element_features(a.element)
    assert b.element.label == "main" and b.linked == 3 / 7


@pytest.mark.parametrize("piece", ["<div>", "<", "<b>", "<a href=\"", "<p x='", "</p>", "<!--", "</b><i>", "&", "<x", "<td>", "<li><div>"])
def test_time_is_linear(piece):
    began = time.perf_counter()
    for b in leaf_blocks(piece * (400_000 // len(piece)) + "end", Elements()):
        extraction.element_features(b.element)
    assert time.perf_counter() - began < 20


def test_decode_against_all_labelings():
    r = np.random.default_rng(0)
    page = "<div class=a><p>One.<p>Two <a>x</a></div><div class=b>three<p>Four four four.</div><h2>Five</h2>six"
    blocks = leaf_blocks(page, Elements())
    features, steps = extraction.page_features(blocks)
    for _ in range(20):
        model = extraction.Crf({f: r.normal() for own, around in features for f in (*own, *around)}, r.normal(size=(3, 2, 2)) * 2, 0.3)
        own = [model.base + sum(model.weights[f] for f in (*a, *b)) for a, b in features]
        score = lambda y: sum(s * v for s, v in zip(own, y)) + sum(model.turns[k][a][b] for k, a, b in zip(steps, y, y[1:]))  # noqa: E731, B023
        assert model.decode(blocks) == list(map(bool, max(itertools.product((0, 1), repeat=len(blocks)), key=score)))


def test_held_out_layouts():
    model, right, whole = extraction.default_model(), [], 0
    pages = labelled_pages(150, seed=99)
    for p in pages:
        blocks = leaf_blocks(p, Elements())
        same = [a == (b.element.label == "main") for a, b in zip(model.decode(blocks), blocks)]
        right += same
        whole += all(same)
    assert sum(right) / len(right) > 0.985 and whole / len(pages) > 0.8


@pytest.mark.parametrize("k", range(len(PAGES)))
def test_pages_by_hand(k):
    page, blocks = PAGES[k]
    assert extraction.main_text(page, extraction.default_model(), Elements()).split("\n\n") == blocks


def test_learning_is_general():
    """Labels on pages of another kind are learnt, too; without pages nothing is main."""
    pages = [f"<html data-label=other><body><p class=q>{w}</p><div class=z data-label=main><p>{w}</p></div><p class=q>{w}</p>" for w in ("one", "two", "three", "four")]
    model = extraction.fit(pages)
    assert [model.decode(leaf_blocks(p, Elements())) for p in pages] == [[False, True, False]] * 4
    assert extraction.main_text("<p>a</p>", extraction.fit([]), Elements()) == ""


def plain(page):
    inside = (page or "").split("<article>")[1].split("</article>")[0]
    blocks = (" ".join(html.unescape(re.sub("<[^>]+>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inside))
    return "\n\n".join(b for b in blocks if b)


def test_query_against_plain(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = op13_extraction(spark, SF).collect()
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in out} == {i: (p.url, plain(p.html), len(plain(p.html))) for i, p in pages.items()} and len(out) == len(pages)


def test_odd_rows(spark):
    article = "<article><h1>A title here</h1><p>Some words that make a sentence, and more of them.</p></article>"
    long = "<article>" + "<p>Many words, again and again, in a paragraph of a long page.</p>" * 20_000 + "</article>"
    rows = [(1, None, "x", "n"), (1, "", "x", "n"), (None, article, None, None), (2, article, "y", "n"), (2, article, "y", "n"), (3, "<p>", "z", ""), (4, long, "l", "")]
    frame = spark.createDataFrame(rows, "page_id int, html string, text string, said string")
    out = extraction.extract(frame, extraction.default_model())
    assert out.columns == ["page_id", "html", "said", "text", "n_chars"]
    got = sorted((r.page_id or 0, r.said, r.text, r.n_chars) for r in out.where("page_id is null or page_id < 4").collect() if r.said != "" or True)
    title = "A title here\n\nSome words that make a sentence, and more of them."
    assert got == sorted([(1, "n", "", 0), (1, "n", "", 0), (0, None, title, len(title)), (2, "n", title, len(title)), (2, "n", title, len(title)), (3, "", "", 0)], key=lambda r: (r[0], r[2]))
    (whole,) = out.where("page_id = 4").collect()
    assert whole.text.count("\n\n") == 19_999
    assert extraction.extract(frame.limit(0), extraction.default_model()).collect() == []
