from __future__ import annotations

import html
import re
import time

import numpy as np

from customsloom.llm import html_blocks as hb
from tests.conftest import SF


def test_leaves():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>no</p>";</script></head><body><!-- <p>no</p> --><ul><li>one<li>two</ul>
    <p>A&nbsp;&amp; b<br>c <a href="x">link</a> d<p class='note'>E &lt;f&gt;<div>g<noscript>no</noscript></div>tail"""
    assert [(b.path, b.text) for b in hb.leaves(page)] == [
        (["html", "body", "ul", "li"], "one"), (["html", "body", "ul", "li"], "two"), (["html", "body", "p"], "A & b c link d"),
        (["html", "body", "p", ".note"], "E <f>"), (["html", "body", "div"], "g"), (["html", "body"], "tail"),
    ]
    assert hb.leaves(None) == [] == hb.leaves("") == hb.leaves("<p></p><script>x")


def test_heads_end_where_browsers_end_them():
    article = "<article><p>one</p><p>two</p></article>"
    for head in (
        "<html><head><title>t</title><body>", "<head><meta charset=utf-8><link rel=x>", "<head><script>if (a < b) {}</script><style>p {}</style><main>", "<html><head><title>t</title></head><body>", "<head></head>", "<title>t</title><meta x>", "<head>\n <base href=/ ><noscript>n</noscript>\n",
        "<head><template><p>no</p></template>", "<body><head><title>t</title>", "<html><head><head>", "<HEAD><TITLE>T</TITLE><BODY>", "<head>\n<!-- c --><div>",
    ):
        assert [b.text for b in hb.leaves(head + article)] == ["one", "two"], head
    assert [b.text for b in hb.leaves("<head><title>t</title>words <b>and</b> more<p>one")] == ["words and more", "one"]
    assert [b.text for b in hb.leaves("<div><p>one<head><p>two")] == ["one", "two"]


def test_comments_and_formulas():
    for comment in ("<!-- no -->", "<!-- no --!>", "<!-->", "<!--->", "<!-- a -- b --!> <!-- > no -->", "<!---->", "<!no>", "<?no?>"):
        assert [b.text for b in hb.leaves(f"<p>one</p>{comment}<p>two</p>")] == ["one", "two"], comment
    assert hb.leaves("<!-- no <p>two</p>") == []
    assert [b.text for b in hb.leaves("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds<svg><text>no</text></svg>")] == ["so x=2 holds"]
    began = time.time()
    assert len(hb.leaves("<!-- x --><p>y" * 60_000 + "--!>")) == 60_000 and time.time() - began < 20


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    model = hb.Labeller(size=4)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, mask = rng.standard_normal((5, 2, hb.DIMS)), np.ones((5, 2))
    mask[3:, 1] = 0
    truth = (rng.random((5, 2)) < 0.5).astype(float)
    _, g = model.gradients(x, mask, truth)
    for k in ("wf", "wb", "bf", "out", "bias"):
        flat, i = model.p[k].reshape(-1), 1 % model.p[k].size
        keep, losses = flat[i], []
        for step in (1e-4, -1e-4):
            flat[i] = keep + step
            losses.append(model.gradients(x, mask, truth)[0])
        flat[i] = keep
        assert abs((losses[0] - losses[1]) / 2e-4 - g[k].reshape(-1)[i]) < 2e-3


def test_held_out_pages_and_layouts(spark):
    """Pages of the supplied kind that the model hasn't seen, and the same words in layouts it hasn't seen, many of them deep and of many classes."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]
    model = hb.train(pages[:120])
    rng, wrong, total = np.random.default_rng(9), 0, 0
    for page in pages[120:180]:
        blocks = hb.leaves(page)
        inside = page[page.index("<article>") : page.index("</article>")]
        want = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:h1|p)>", inside)]
        hit = hb.label(model, [blocks])[0]
        assert [" ".join(b.text.split()) for b, y in zip(blocks, hit, strict=True) if y] == [w for w in want if w]
        laid, y = hb.relaid(blocks, np.array([b.told for b in blocks], np.float32), rng)
        wrong, total = wrong + int((hb.label(model, [laid])[0] != (y > 0)).sum()), total + len(y)
    assert wrong / total < 0.04


PROSE = ["The river rose overnight and the lower road was closed before the first buses left.", "Nobody in the village could recall a spring like it, and the miller said so twice.", "By noon the water had reached the school, where the children were sent upstairs.", "It fell again on Thursday, leaving a line of silt along the churchyard wall."]
def test_no_page_with_an_article_is_empty(spark):
    """The whole query over supplied pages whose heads lack end tags, with odd comments in front."""
    pages = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    as_it_was = {r["page_id"]: r["text"] for r in hb.extract_pages(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    headless = [(i, u, re.sub("</head>", "", "<!-- note --!>" + h, flags=re.I)) for i, u, h in pages]
    got = {r["page_id"]: r["text"] for r in hb.extract_pages(spark.createDataFrame(headless, "page_id bigint, url string, html string")).collect()}
    assert got == as_it_was and all(got.values())


#: Pages marked by hand: what the article is, whatever the mark-up says.
MARKED = [
    (f"<body><nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav><main><h1>Flood</h1><p>{PROSE[0]}<p>{PROSE[1]}</main><footer>&copy; 2024 The Paper</footer>", ["Flood", PROSE[0], PROSE[1]]),
    (f"<body><header><div class='logo masthead'>The Paper</div></header><div class='container row'><div class='col md'><div class='post entry'><h2>Flood</h2><p>{PROSE[0]}</p><div class='ad'>Buy boots now</div><p>{PROSE[2]}</p></div></div></div><div class='footer'>About us</div></body>", ["Flood", PROSE[0], PROSE[2]]),
    (f"<body><div class='cookie notice'>We use cookies.</div><article><h1>Flood</h1><p>{PROSE[1]}</p><blockquote>{PROSE[3]}</blockquote></article><section class='comments'><div class='comment'><p>{PROSE[0]}</p></div><div class='comment'><p>I was there and saw it.</p></div></section></body>", ["Flood", PROSE[1], PROSE[3]]),
    ("<body>" + "<div class='col md widget inner wrap'>" * 12 + f"<article><h1>Flood</h1><p>{PROSE[0]}</p><p>{PROSE[1]}</p><p>{PROSE[2]}</p></article>" + "</div>" * 12 + "<footer>" + "<div class='col md widget inner wrap'>" * 12 + "<p>All rights reserved by the owners of this page.</p>", ["Flood", *PROSE[:3]]),
    (f"<body><aside class=sidebar><p>{PROSE[3]}</p></aside><div class=content><p>{PROSE[0]}</p><ul><li>{PROSE[1]}</li><li>{PROSE[2]}</li></ul><form class=newsletter><p>Leave your address</p></form></div>", [PROSE[0], PROSE[1], PROSE[2]]),
]


def test_pages_marked_by_hand(spark):
    model = hb.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    wrong = total = 0
    for page, want in MARKED:
        blocks = hb.leaves(page)
        got = [b.text for b, y in zip(blocks, hb.label(model, [blocks])[0], strict=True) if y]
        total += len(blocks)
        wrong += len(set(got) ^ set(want))
    assert wrong <= 0.1 * total


def test_every_word_and_part_counts():
    deep = ["html", "body", "footer", *(x for _ in range(20) for x in ("div", ".col", ".md", ".widget"))]
    element, other = hb.Element.of(deep), hb.Element.of(["html", "body", "article", *deep[3:]])
    words = " ".join(f"w{i}" for i in range(3000))
    rows = hb.vectors([hb.Leaf(element, words, 0), hb.Leaf(other, words, 0), hb.Leaf(element, words + " last", 0)])
    assert element.parts == deep and (rows[0] != rows[1]).any() and (rows[0, 2 * hb.PATH_DIMS :][: hb.WORD_DIMS] != rows[2, 2 * hb.PATH_DIMS :][: hb.WORD_DIMS]).any()
    assert not hb.Leaf(element, "x", 0).told and hb.Leaf(other, "x", 0).told


def test_hostile_pages_take_time_in_proportion():
    n = 100_000
    pages = {"<a " * (n * 3): 1, "<div>x" * n: n, "<!--" * n: 0, "<p>a</b>" * n: n, "<b>" * n + "</i>" * n + "x": 1, "<a " + "'x' " * n + ">y": 1, "<script>" * n: 0, "<span>" * n + "<hr>z" * n: n, "</p>" * n + "t": 1, "<a href='" * n: 1, "&lt" * n: 1}
    for page, blocks in pages.items():
        began = time.process_time()
        assert len(hb.leaves(page)) == blocks, page[:20]
        assert time.process_time() - began < 10, page[:20]


def test_long_pages_run_in_steps():
    model, rng = hb.Labeller(), np.random.default_rng(3)
    page = [hb.Leaf(hb.Element.of(["body", ("p", "nav", "article")[rng.integers(3)]]), " ".join(map(str, rng.integers(0, 50, 5))), 0) for _ in range(100)]
    assert (hb.label(model, [page], most=7)[0] == hb.label(model, [page])[0]).all()


def test_odd_rows(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    odd = [(-1, None, None), (-2, "u", ""), (-2, "u", ""), (None, "u", "plain"), (-3, "u", "<article>" + "<p>Long text here.</p>" * 3000 + "</article>"), (-4, "u", "<p" * 50), (-5, "u", "<article><p>a\ud7ff</p>")]
    both = pages.unionAll(spark.createDataFrame(odd, "page_id bigint, url string, html string")).selectExpr("*", "1 AS text")
    got = hb.extract_pages(both).collect()
    assert len(got) == both.count()
    by = {r["page_id"]: r for r in got}
    assert by[-1]["text"] == "" and by[-1]["n_chars"] == 0 and by[-1]["url"] is None and by[-3]["n_blocks"] == 3000
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_empty_table(spark):
    assert hb.extract_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
