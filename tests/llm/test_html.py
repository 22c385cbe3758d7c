import html as H
import re

import numpy as np
import pytest

from spanlake.llm import html


@pytest.fixture(scope="module")
def forest(spark):
    return html.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def of_article(page):
    """The blocks of an article of plain paragraphs and headings."""
    body = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    parts = (re.sub(r"\s+", " ", H.unescape(re.sub("<[^>]*>", " ", p))).strip() for p in re.split(r"</?p>|</?h1>", body))
    return "\n\n".join(p for p in parts if p)


def test_given_pages(spark, forest):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in html.with_main_text(pages, forest).collect():
        assert r.text == of_article(r.html)


PROSE = [f"Paragraph {i} tells of many things, such as the sea & the sky; it goes on for a while, and ends here." for i in range(8)]
OTHER = """<html><head><title>T</title><script>var x = "<p>no</p>";</script></head><body>
<header><a href=/>Home</a></header><div class="cookie-notice"><p>We use cookies.</p><button>OK</button></div>
<nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<div class=post-content><h2>Heading</h2>%s<div class="newsletter-signup"><form><label>Mail</label><input name=m></form></div><p>Last &eacute;&nbsp;&#8364; &lt;b&gt;
   words,<br>after a break.</div>
<aside class="sidebar"><p>Read also this.</p></aside><section id="comments"><p>I think so too, it is really good.</p></section>
<footer>&copy; us</footer></body></html>""" % "".join(f"<p>{p.replace('&', '&amp;')}" for p in PROSE)


def test_another_template(forest):
    want = "\n\n".join(["Heading", *PROSE, "Last é € <b> words, after a break."])
    assert html.main_texts([OTHER], forest) == [want]


def test_chosen_is_the_best_consistent_choice():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = 9
        nodes = [html.Node("#root", -1, 0)]
        for i in range(1, n):
            parent = int(rng.integers(i))
            nodes[parent].children.append(i)
            nodes.append(html.Node("div", parent, 0))
        value = rng.normal(size=n)
        best = -np.inf
        for mask in range(1 << (n - 1)):
            keep = [True, *(bool(mask >> i & 1) for i in range(n - 1))]
            if all(keep[nodes[i].parent] for i in range(1, n) if keep[i]):
                best = max(best, value[keep].sum())
        keep = html.chosen(nodes, value)
        assert all(keep[nodes[i].parent] for i in range(1, n) if keep[i])
        assert np.isclose(value[keep].sum(), best)


def test_trees_as_arrays_match_the_model(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    rows = spark.createDataFrame([(v.tolist(), float(v[0] * v[1] > 0)) for v in x], "x array<double>, label double")
    rows = rows.select(array_to_vector("x").alias("features"), "label")
    model = GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(rows)
    want = [r.p for r in model.transform(rows).select(vector_to_array("probability")[1].alias("p")).collect()]
    assert np.allclose(1 / (1 + np.exp(-html.as_arrays(model).log_odds(x))), want)
    assert F


ODD = [None, "", "   ", "plain text only", "<p>unclosed <b>bold<p>second", "</div></p>stray", "<article>" * 300 + "deep" + "</article>" * 300, "<!-- never closed <p>x", "<article><p>" + "long word " * 50000 + "</p></article>", "<table><tr><td>a<td>b<tr><td>c</table>", "\x00<a", "<article></article>"]


@pytest.mark.parametrize("pages", [ODD + ODD[-4:], []], ids=["odd", "empty"])
def test_odd_pages(spark, forest, pages):
    frame = spark.createDataFrame([(None if i == 3 else i, None if i == 4 else "u", p, 5) for i, p in enumerate(pages)], "page_id long, url string, html string, text int")
    out = html.with_main_text(frame, forest)
    assert out.columns == ["page_id", "url", "html", "text"]
    found = out.collect()
    assert len(found) == len(pages) and all(r.text is not None for r in found)
    by_html = {}
    for r in found:
        assert by_html.setdefault(r.html, r.text) == r.text
    if pages:
        assert by_html[None] == by_html[""] == by_html["   "] == by_html["<article></article>"] == ""
        assert by_html[ODD[8]] == ("long word " * 50000).strip()


def bare(i, copies=1):
    """A page whose main text stands in a div of no telling name."""
    prose = "".join(f"<p>{p} ({i})</p>" for p in PROSE[: 3 + i % 6])
    menu = "".join(f"<li><a href=/{k}>Part {k}</a></li>" for k in range(6))
    return f"<body><nav><ul>{menu}</ul></nav><div class=text>{prose}</div><footer><p>&copy; us</p></footer></body>".replace("& ", "&amp; ")


def test_no_page_names_its_article(spark):
    docs = [(i, bare(i)) for i in range(40)]
    frame = spark.createDataFrame(docs, "page_id long, html string")
    found = {r.page_id: r.text for r in html.with_main_text(frame, html.fit(frame)).collect()}
    assert found == {i: "\n\n".join(f"{p} ({i})" for p in PROSE[: 3 + i % 6]) for i in range(40)}


def test_sample_is_of_different_named_pages(spark, monkeypatch):
    monkeypatch.setattr(html, "SAMPLE", 5)
    monkeypatch.setattr(html, "EXAMPLES", 0)
    named = [f"<body><nav>menu</nav><article><p>Text {i} of a page.</p></article></body>" for i in range(5)]
    pages = [None, "", *[bare(i) for i in range(50)], *named[:1] * 300, *named]
    frame = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "page_id long, html string")
    rows = html.training_rows(frame, "page_id", "html").count()
    want = sum(len(nodes) - 1 for p in named for nodes, _ in html.variants(html.tree_of(p), 0)[:1])
    alone = html.training_rows(spark.createDataFrame([(0, p) for p in named], "page_id long, html string"), "page_id", "html").count()
    assert rows == alone > want


def test_without_a_fit_the_markup_decides():
    assert html.main_texts(["<nav>a</nav><article><p>b<aside>c</aside></article>"], None) == ["b"]
