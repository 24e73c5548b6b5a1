"""Extraction of main texts: the reader by cases, the field by enumeration, the whole by held-out layouts and by the given pages."""

import html as library
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from engrava.llm import html_text
from engrava.llm.html_blocks import leaf_blocks
from engrava.llm.html_text import Model, default_model, extract_pages, fit, op11_block_field
from engrava.llm.labelled_pages import LAYOUTS, labelled_pages
from tests.llm.helpers import SF, clashing

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])


def texts(page):
    return [text for _, text, _ in leaf_blocks(page, lambda tag, source, around: tag)]


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p>a<p>b</p>c", ["a", "b", "c"]),
        ("<p><b>a.<br><p>b</p>", ["a.", "b"]),
        ("<p>one<br>two  \n three</p>", ["one two three"]),
        ("<b>x<p>y</b> z</p>", ["x", "y z"]),
        ("<ul><li>a<li>b<ul><li>c</ul>d</ul>", ["a", "b", "c", "d"]),
        ("<table><tr><td>a<td>b</div>c<tr><td>d</table>e", ["a", "b", "c", "d", "e"]),
        ("<dl><dt>a<dd>b<dt>c</dl>", ["a", "b", "c"]),
        ("a<script>var x='<p>no</p>';</script>b<style>p{}</style>c", ["a b c"]),
        ("a<script>never closed <p>b", ["a"]),
        ("<title>t</title><textarea><p>x</textarea>y", ["y"]),
        ("a<!-- <p>b</p> -->c<!-->d<!doctype html>e<?x?>f", ["acdef"]),
        ("a<!-- open <p>b", ["a"]),
        ('<p title="a>b" x=\'c>d\'>e</p>', ["e"]),
        ("<p title=it's>e</p><p>it's</p>", ["e", "it's"]),
        ("1 < 2 &amp; 3 &lt; 4 &copy; &#65;&#x42;&nbsp;c &am &quot;", ["1 < 2 & 3 < 4 © AB c &am \""]),
        ("<svg><text>no</text></svg><template>no</template>yes", ["yes"]),
        ("<P CLASS=x>a</P><Div>b</dIV>", ["a", "b"]),
        ("</p></div>a</p>b<br/>c</br>d", ["a", "b c d"]),
        ("a<div class='open", ["a"]),
        ("", []),
        (" \n\t&nbsp;", []),
    ],
)
def test_reader(page, want):
    assert texts(page) == want


def test_reader_on_deep_and_long_pages():
    assert texts("<div>" * 20_000 + "x" + "</div>" * 20_000 + "y") == ["x", "y"]
    assert texts("<b>" * 20_000 + "<p>x</p>" * 5_000) == ["x"] * 5_000
    assert len(texts("<p>" + "word " * 500_000)[0]) == 2_499_999
    assert texts('<a x="' * 5_000) == []


def chain_scores(unary, joint):
    return {labels: sum(unary[t, y] for t, y in enumerate(labels)) + sum(joint[t, a, b] for t, (a, b) in enumerate(zip(labels, labels[1:]))) for labels in itertools.product((0, 1), repeat=len(unary))}


def test_expectations_by_enumeration():
    rng = np.random.default_rng(3)
    unary, joint = rng.normal(size=(3, 5, 2)), rng.normal(size=(3, 4, 2, 2))
    mask = np.arange(5) < np.array([[5], [3], [1]])
    unary[~mask] = 0
    one, two = html_text._expected(unary, joint, mask)
    for k, n in enumerate((5, 3, 1)):
        scores = chain_scores(unary[k, :n], joint[k])
        total = sum(np.exp(s) for s in scores.values())
        for t in range(n):
            assert one[k, t, 1] == pytest.approx(sum(np.exp(s) for y, s in scores.items() if y[t]) / total)
            assert t + 1 >= n or two[k, t, 1, 0] == pytest.approx(sum(np.exp(s) for y, s in scores.items() if y[t] and not y[t + 1]) / total)
        assert not two[k, n - 1 :].any()


def test_best_path_by_enumeration():
    rng = np.random.default_rng(4)
    fitted = fit(labelled_pages(1), steps=1)
    for page in labelled_pages(1):
        model = Model(fitted.features, rng.normal(size=len(fitted.features)), rng.normal(size=(3, 2, 2)))
        blocks = leaf_blocks(page, html_text._reader(model.features))[:9]
        page_got = [main for _, main in model.label(page)]
        if len(page_got) > 9:
            continue
        unary = np.zeros((len(blocks), 2))
        for t, (e, text, linked) in enumerate(blocks):
            unary[t, 1] = sum(model.weights[f] for f in e.seen.features) + sum(model.weights[model.features[f]] for f in html_text.text_features(e.tag, text, linked) if f in model.features)
        scores = chain_scores(unary, np.tensordot(html_text._joints(blocks), model.joints, 1))
        assert tuple(map(int, page_got)) == max(scores, key=scores.get)


def marks(page):
    return [(text, e.seen.main) for e, text, _ in leaf_blocks(page, html_text._reader(None))]


def test_learns_its_pages_and_layouts_held_out():
    assert all(default_model().label(p) == marks(p) for p in labelled_pages(2))
    right = total = 0
    for part in range(5):
        model = fit(labelled_pages(4, [x for k, x in enumerate(LAYOUTS) if k % 5 != part]))
        for page in labelled_pages(4, LAYOUTS[part::5]):
            want = marks(page)
            right += sum(a == b for a, b in zip(model.label(page), want))
            total += len(want)
    assert right / total > 0.92


def test_fit_without_pages():
    assert fit([]).label("<p>a</p>") == [("a", False)] and fit(["", "<p></p>"]).main_text("<p>a</p>") == ""


def article(page):
    """Of the given tables' pages: the article's blocks."""
    inside = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = (" ".join(library.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inside))
    return "\n".join(b for b in blocks if b)


def test_query_on_whole_table(spark):
    got = {r.page_id: tuple(r) for r in op11_block_field(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert got == {r.page_id: (r.page_id, r.url, article(r.html), len(article(r.html))) for r in rows}


def test_parts_that_go():
    page = """<!DOCTYPE html><html><body><header class="site-header"><a href="/">Brand</a></header><div class="cookie-notice"><p>We use cookies.</p><button>Accept</button></div>
    <nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><main><article><h1>A  title</h1><p>First &amp; foremost,
    a paragraph.</p><div class="advert"><p>Buy this now, it is cheap.</p></div><p>Second.</p><form class="newsletter"><label>Your email address</label><button>Sign up</button></form><p>Third one here.</p></article>
    <section id="comments"><h2>Comments</h2><div class="comment"><p>I liked reading this very much.</p></div></section></main><aside class="sidebar"><h3>Related</h3><ul><li><a href="/c">More</a></li></ul></aside>
    <footer><p>© 2024 Brand. All rights reserved.</p></footer><script>x()</script></body></html>"""
    assert default_model().main_text(page) == "A title\nFirst & foremost, a paragraph.\nSecond.\nThird one here."


def test_awkward_tables(spark):
    page = "<nav><a href='/'>x</a></nav><article><h1>T</h1><p>It is.</p></article>"
    rows = [(1, "u", None), (2, None, ""), (None, None, page), (None, None, page), (3, "u", " \n"), (4, "u", "<article>" + "<p>Words that go on.</p>" * 20_000 + "</article>"), (5, "u", "<"), (6, "u", "plain \x00 &#0; &#xD800; text")]
    for df in (spark.createDataFrame(rows, PAGES), clashing(spark, spark.createDataFrame(rows, PAGES))):
        got = {(r.page_id, r.url): r for r in extract_pages(df).collect()}
        assert extract_pages(df).count() == len(rows)
        assert got[None, None].text == "T\nIt is." and got[None, None].n_chars == 8
        assert [got[k].text for k in ((1, "u"), (2, None), (3, "u"))] == [""] * 3
        assert got[4, "u"].text == "\n".join(["Words that go on."] * 20_000)
    assert extract_pages(spark.createDataFrame([], PAGES)).count() == 0
