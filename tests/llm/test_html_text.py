"""Main text of pages: the tree, exact marginals, and held-out pages."""

import html
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankspark.llm import html_layouts, html_text, html_tree

SCHEMA = "page_id long, url string, html string"


def leaves(page):
    return [n.text for n in html_tree.read(page) if n.leaf and n.chars]


@pytest.mark.parametrize(("page", "blocks"), [
    ("<p>one<p>two<div>three<p>four</div>five", ["one", "two", "three", "four", "five"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    ("<table><tr><td>a<td>b<tr><td><p>c</table>d", ["a", "b", "c", "d"]),
    ("<p><b>A.<br><p>B</b> c", ["A.", "B c"]),
    ("a<!-- <p>no</p> -->b<script>'</p>' < 1</script>c", ["abc"]),
    ("x<script>never ends <p>y", ["x"]),
    ("x<!-- never ends <p>y", ["x"]),
    ("1 < 2 &lt; 3 &amp;amp; &eacute;&#x4e2d; <3</p>", ["1 < 2 < 3 &amp; é中 <3"]),
    ("<p title='a>b' class=x>q</p></div></span>r", ["q", "r"]),
    ("<p class=\"open>never closed", ["never closed"]),
    ("  a\n\t b\xa0 c  ", ["a b c"]),
    ("<title>t</title><body>u<textarea>v</textarea>w", ["uw"]),
    ("<a href=x>l</a> m <i>n", ["l m n"]),
    ("</", []), ("<", ["<"]), ("<p", []), ("", []), ("<?php x ?>y<!doctype html>", ["y"]),
])
def test_blocks(page, blocks):
    assert leaves(page) == blocks


def test_deep_and_long_pages_stay_linear():
    deep = "<div>" * 50_000 + "x" + "<p>y" * 20_000
    assert leaves(deep) == ["x"] + ["y"] * 20_000
    assert "".join(leaves("<a b='" * 50_000 + "x")) in ("", "x") and len(leaves("<" * 300_000)[0]) == 300_000
    assert leaves("<!--" * 100_000) == [] and leaves("<script>" * 50_000) == []
    nodes = html_tree.read(deep)
    assert len(html_tree.features(nodes)) == len(nodes)


def test_marginals_are_exact():
    rng = random.Random(2)
    for _ in range(30):
        n = rng.randint(1, 9)
        unary = [rng.uniform(-3, 3) for _ in range(n)]
        parents = [-1] + [rng.randrange(i) for i in range(1, n)]
        kinds = [rng.randrange(4) for _ in range(n)]
        pairs = np.array([[[rng.uniform(-2, 2) for _ in range(2)] for _ in range(2)] for _ in range(4)])
        odds = html_text.marginals(unary, parents, kinds, [tuple(np.exp(p).reshape(-1)) for p in pairs])
        weight = {}
        for y in itertools.product((0, 1), repeat=n):
            s = sum(u * a for u, a in zip(unary, y, strict=True)) + sum(pairs[kinds[i]][y[parents[i]]][y[i]] for i in range(1, n))
            weight[y] = math.exp(s)
        for i in range(n):
            yes = sum(w for y, w in weight.items() if y[i])
            assert odds[i] == pytest.approx(math.log(yes / (sum(weight.values()) - yes)))


def test_gradient_is_that_of_the_likelihood():
    rows = []
    for seed in range(3):
        found = html_text._example(html_layouts.layouts(f"g{seed}", [], [], 1)[0])
        rows.append({"sizes": [len(f) for f in found[0]], "features": [x for f in found[0] for x in f], "parents": found[1], "kinds": found[2], "labels": found[3]})
    trees = html_text._Trees(rows)
    n = len(html_tree.NAMES)
    theta = np.random.default_rng(1).normal(0, 0.3, n + 16)
    weights, pairs = theta[:n], theta[n:].reshape(4, 2, 2)
    p, _ = trees.expected(weights, pairs)
    at = 0
    for r in rows:
        size, step = len(r["parents"]), 0
        unary = []
        for k in r["sizes"]:
            unary.append(sum(weights[f] for f in r["features"][step : step + k]))
            step += k
        odds = html_text.marginals(unary, r["parents"], r["kinds"], [tuple(np.exp(x).reshape(-1)) for x in pairs])
        assert p[at : at + size] == pytest.approx([1 / (1 + math.exp(-o)) for o in odds])
        at += size
    # With all weights 0 every labelling is as likely, so an edge's four cells are.
    _, counts = trees.expected(np.zeros(n), np.zeros((4, 2, 2)))
    assert counts == pytest.approx(np.repeat(trees.seen.sum((1, 2)) / 4, 4).reshape(4, 2, 2))


@pytest.fixture(scope="module")
def pages(spark, small):
    return spark.read.parquet(f"{small}/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return html_text.fit(pages)


def test_articles_of_the_table(pages, model):
    """The table's pages have one article of h1 and p elements; nothing else is its text."""
    rows = html_text.extract(pages.withColumns({"page": F.col("html"), "TEXT": F.lit("x")}), model).collect()
    assert len(rows) == pages.count()
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|$)", r.page, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article))
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_held_out_layouts(model):
    """Pages of other layouts, with texts that training has not seen."""
    hit = false = missed = 0
    for page in (p for s in range(200) for p in html_layouts.layouts(f"held out {s}", [], [], 1)):
        nodes = html_tree.read(page)
        for node, y, odds in zip(nodes, html_text.labels_of(nodes), model.log_odds(nodes), strict=True):
            if node.leaf:
                hit += node.chars * (y and odds >= 0)
                false += node.chars * (not y and odds >= 0)
                missed += node.chars * (y and odds < 0)
    assert hit / (hit + false) > 0.95 and hit / (hit + missed) > 0.97


PARAGRAPHS = [
    "The ferry left the old harbour before sunrise, and nobody on the quay had noticed that the gate was open.",
    "By noon, the captain had written three letters; none of them would be sent, as he knew very well.",
    "When the rain came, the crew went below deck & waited for the evening bell, which rang twice."]


@pytest.mark.parametrize("wrap", [
    "<main>{}</main>", "<div id=content>{}</div>", "<div class='post-body'>{}</div>", "<section class=story><div>{}</div></section>"])
def test_a_written_page(model, wrap):
    body = "".join(f"<p>{html.escape(p)}</p>" for p in PARAGRAPHS)
    page = f"""<html><head><title>Ferry</title><style>p{{}}</style></head><body><header class="site-header"><a href="/">Home</a> The Daily Gull</header>
    <div class="menu"><ul><li><a href=/a>News</a><li><a href=/b>Sport</a></ul></div><div class="cookie-consent"><p>We use cookies to make this site work better for you, and others.</p></div>
    {wrap.format('<h1>The ferry</h1>' + body + '<div class="advert">Buy two boats, get one free today.</div>')}
    <section id="comments"><h3>Comments</h3><div class="comment"><p>I was on that ferry, and the gate was never open, whatever the paper says about it.</p></div></section>
    <form action=/q>Search the archive <input name=q></form><aside><h4>More</h4><p>Ten harbours you should see before you are old.</p></aside>
    <footer>&copy; The Daily Gull. All rights reserved.</footer></body></html>"""
    assert model.text(page) == "\n\n".join(["The ferry", *PARAGRAPHS])


def test_odd_rows(spark, pages, model):
    rows = [(1, "u", None), (1, "u", ""), (None, None, "plain"), (2, "v", "<nav><a href=x>y</a></nav>"), (3, "w", "<article><p>" + "word, " * 200_000 + "</article>")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {(r.page_id, r.url): r for r in html_text.extract(df.where("page_id is not null"), model).collect()}
    assert found[1, "u"].text == "" and found[1, "u"].n_chars == 0 and found[2, "v"].text == ""
    assert found[3, "w"].n_chars == len("word, " * 200_000) - 1
    assert html_text.extract(df, model).count() == 5
    assert html_text.extract(df.limit(0), model).collect() == []


def test_a_table_without_articles_has_a_model_too(spark):
    none = html_text.fit(spark.createDataFrame([], SCHEMA))
    page = "<nav><a href=/>Home</a></nav><article>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS[:2]) + "</article><footer>&copy; us</footer>"
    assert none.text(page) == "\n\n".join(PARAGRAPHS[:2])
