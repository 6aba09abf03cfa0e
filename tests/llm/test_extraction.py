import html
import re
import time
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusweave.llm.dom import leaf_blocks
from corpusweave.llm.extraction import (
    ChainModel,
    block_features,
    default_extractor,
    extract_main_text,
    sample_pages,
    train_chain,
)
from corpusweave.llm.queries import QUERIES


def texts(page):
    return [b.text for b in leaf_blocks(page)]


@pytest.mark.parametrize(
    "page, want",
    [
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>a<p>b", ["a", "b"]),
        ("<ul><li>x<li>y</ul>z", ["x", "y", "z"]),
        ("<div>a<b>b</b>c<br>d\n e</div>f", ["abc d e", "f"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
        ("<p title=\"a>b\">x</p><p title='", ["x"]),
        ("a < b &lt; c&nbsp;d", ["a < b < c d"]),
        ("<head><title>t</title><p>x", ["x"]),
        ("<head><title>t</title></head><body>x", ["x"]),
        ("<!-- a --><p>k<!-- b > c -->l</p><!--", ["kl"]),
        ("<p><script>x('</p>')</script>y<style>p{}</STYLE >z</p>", ["yz"]),
        ("<script>never closed <p>a", []),
        ("<noscript><p>q</p></noscript>w", ["w"]),
        ("</div></p>a</b>b", ["ab"]),
        ("<dl><dt>a<dd>b<dt>c</dl>", ["a", "b", "c"]),
        ("<P CLASS=x>a</P><DIV>b</DIV>", ["a", "b"]),
    ],
)
def test_leaf_blocks(page, want):
    assert texts(page) == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/p'\"=! -ab&;divscript", max_size=80))
def test_any_markup_is_read(page):
    for b in leaf_blocks(page):
        assert b.text == " ".join(b.text.split()) != ""


def test_names_and_links():
    (block,) = leaf_blocks('<div class="site-navBar" id=top1><p role=note>ab <a>cdef</a></p></div>')
    assert [e.names for e in block.path] == [("site", "nav", "bar", "top"), ("note",)]
    assert block.linked == 4


def test_deep_nesting_is_quick():
    assert texts("<div>" * 20_000 + "x" + "</div>" * 20_000) == ["x"]
    assert len(texts("<p>a" * 20_000)) == 20_000


def test_text_at_every_level_of_a_deep_page():
    page = "".join(f'<div class="level{"abc"[i % 3]}">x ' for i in range(100_000))
    start = time.perf_counter()
    tracemalloc.start()
    blocks = leaf_blocks(page)
    found = [block_features(b, i, len(blocks)) for i, b in enumerate(blocks)]
    used = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 100_000 and len(blocks[-1].path) == 100_000
    assert used < 1e9 and time.perf_counter() - start < 60


SENTENCES = "<p>{} this is an ordinary sentence of the article, and it goes on for a while. Another one follows it here.</p>"
ARTICLE = "<h1>The title of it</h1>" + "".join(SENTENCES.format(i) for i in "ABC")
MENU = '<ul class="menu"><li><a href=/a>Home</a><li><a href=/b>News</a><li><a href=/c>About us</a></ul>'
FOOT = "<footer>&copy; 2024 Some Company</footer>"


@pytest.mark.parametrize(
    "body",
    [
        f"<div class='wrap'><div class='c1'>{ARTICLE}</div></div>",
        f"<div id='wrap'>{ARTICLE}</div>",
        f"<div><div>{ARTICLE}</div></div>",
        f"<div class='container-fluid'><div class='row'><div class='col-md-8'>{ARTICLE}</div>"
        f"<div class='col-md-4 sidebar'><h3>Related</h3>{MENU}</div></div></div>{FOOT}",
        f"<nav>{MENU}</nav><div class='page-wrapper'><div class='inner'>{ARTICLE}</div></div>{FOOT}",
        f"<header><div class='css-1q2w'>Site name</div>{MENU}</header><div class='css-9x8y'>"
        f"<section class='sc-abc'>{ARTICLE}</section></div>{FOOT}",
        f"<table><tr><td class='left'>{MENU}</td><td class='main'>{ARTICLE}</td></tr></table>",
        f"<div id='header'><h1>Site</h1></div><div id='nav'>{MENU}</div><div id='content'>{ARTICLE}</div>"
        "<div id='footer'>Copyright 2024</div>",
        f"<article class='post'>{ARTICLE}<div class='share'><a href=x>Share on Facebook</a></div></article>"
        "<section class='comments'><h3>Comments</h3><p>Great read, thanks.</p></section>",
        f"<main>{ARTICLE}</main><aside><p>Popular: other things</p></aside>",
        f"<section class='layout'><section>{ARTICLE}</section></section><div class='cookie-notice'>We use cookies "
        "to improve. <button>Accept</button></div>",
    ],
)
def test_layouts_that_the_training_pages_do_not_have(body):
    want = ["The title of it", *(re.sub("<[^>]+>", "", SENTENCES.format(i)) for i in "ABC")]
    assert default_extractor().extract(f"<body>{body}</body>").split("\n") == want


def test_viterbi_agrees_with_brute_force():
    rng = np.random.default_rng(1)
    blocks = leaf_blocks("<nav>a b</nav><p>c</p><div class=ad>d.</div><p>e f g</p><footer>h</footer><p>i</p>")
    names = {f for i, b in enumerate(blocks) for f in block_features(b, i, len(blocks))}
    for _ in range(30):
        model = ChainModel(
            {f: tuple(rng.normal(size=2)) for f in names},
            tuple(map(tuple, rng.normal(size=(2, 2)))), tuple(rng.normal(size=2)),
        )
        n = len(blocks)
        best = None
        for code in range(2**n):
            y = [code >> i & 1 for i in range(n)]
            s = model.first[y[0]] + sum(model.steps[a][b] for a, b in zip(y, y[1:]))
            s += sum(model.features[f][y[i]] for i, b in enumerate(blocks) for f in block_features(b, i, n))
            best = max(best or (s, y), (s, y))
        assert model.decode(blocks) == [bool(x) for x in best[1]]


def test_training_separates_by_neighbours():
    # A block without telling features takes the label of the block before it.
    page = ([["x"], ["plain"], ["y"], ["plain"]], [1, 1, 0, 0])
    model = train_chain([page] * 5 + [([["y"], ["plain"]], [0, 0])] * 5)
    assert model.steps[0][0] > model.steps[0][1] and model.steps[1][1] > model.steps[1][0]


def test_held_out_pages():
    model, wrong, total = default_extractor(), 0, 0
    for page, labels in sample_pages(200, seed=77):
        got = model.decode(leaf_blocks(page))
        wrong += sum(int(a) != b for a, b in zip(got, labels))
        total += len(labels)
    assert wrong < 0.01 * total


def test_parts_that_go():
    page = """<html><body><div id="cookie-banner">We use cookies.</div><header><h1>Site</h1><nav><a>Home</a></nav></header>
    <main><article><h1>Title here</h1><p>First <i>paragraph</i>.</p><div class="ad">Buy now.</div><p>Second one.</p>
    <ul><li>point one</li><li>point two</li></ul><form><input><button>Subscribe</button></form></article>
    <section class="comments"><h3>Comments</h3><p>Nice article, thank you very much for it.</p></section></main>
    <aside class="sidebar"><p>Related story</p></aside><footer>&copy; 2024</footer></body></html>"""
    assert default_extractor().extract(page) == "Title here\nFirst paragraph.\nSecond one.\npoint one\npoint two"


def plain_article(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = (re.sub(r"<[^>]+>", " ", s) for s in re.split(r"<(?:/?p|/?h1)>", inner))
    return "\n".join(t for b in blocks if (t := " ".join(html.unescape(b).split())))


def test_query_against_brute_force(spark, sf_dir):
    pages = {p.page_id: p for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = QUERIES["op1_extraction"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == plain_article(pages[r.page_id].html)
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_odd_rows(spark, long_text):
    pages = [(1, None), (2, ""), (2, ""), (None, "<p>Just a short text.</p>"), (4, f"<article><p>{long_text}</p></article>")]
    df = spark.createDataFrame([(*p, "t") for p in pages], "page_id long, html string, text string")
    got = extract_main_text(df, keep=("page_id",)).collect()
    assert [r.text for r in got[:3]] == ["", "", ""] and got[3].text == "Just a short text."
    assert got[4].text == long_text.strip() and got[4].n_chars == len(long_text.strip())
    assert extract_main_text(df.limit(0)).count() == 0
