"""Main texts of pages: all kinds of layouts, odd markup, and every page of the table against its article's markup."""

import html as entities
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from resight.llm import html_text
from resight.llm.common import table

LONG = "The river runs past the old mill, and on summer evenings the whole village comes down to the water to hear the band play."
MORE = "Nobody remembers who built the mill; the oldest deeds speak of a miller named Ode, who paid his rent in flour and eels."
MENU = "<ul><li><a href=/a>Home</a><li><a href=/b>News and weather</a><li><a href=/c>About us</a></ul>"

LAYOUTS = {
    "article": f"<html><body><nav>{MENU}</nav><article><h1>Mill</h1><p>{LONG}<p>{MORE}</p><p>End.</p></article><footer>&copy; 2020 The Village</footer></body></html>",
    "main with asides": f"<body><header><h2>The Village Paper</h2>{MENU}</header><main><h1>Mill</h1><div class='ad'>Buy eels today at a price you will not believe, only here!</div><p>{LONG}</p><aside>See also our long list of other mills in the county.</aside><p>{MORE}</p><p>End.</p></main></body>",
    "divs": f"<body><div id='top'>{MENU}</div><div class='wrap'><div class='sidebar'><p>{MORE}</p></div><div class='text'><h1>Mill</h1><p>{LONG}</p><p>{MORE}</p><p>End.</p></div></div><div id='footer'>All rights reserved by the Village Paper, {LONG}</div></body>",
    "heading beside": f"<body><div>{MENU}</div><h1>Mill</h1><div><p>{LONG}</p><p>{MORE}</p><p>End.</p></div></body>",
    "comments": f"<body><article><header><h1>Mill</h1></header><p>{LONG}</p><p>{MORE}</p><p>End.</p><section id='comments'><h2>Comments</h2><p>{LONG} I was there.</p></section></article><div class='comment-list'><article class='comment'><p>{LONG} So was I, and it was not like that.</p></article></div></body>",
    "form and notice": f"<body><div class='cookie-notice'>{LONG} We use cookies.</div><article><h1>Mill</h1><p>{LONG}</p><form><p>Your name and address, please</p><input><button>Send</button></form><p>{MORE}</p><p>End.</p></article></body>",
    "table layout": f"<body><table><tr><td>{MENU}<td><h1>Mill</h1><p>{LONG}<p>{MORE}<p>End.</table></body>",
    "classes of the page": f"<body class='has-sidebar no-ads'><div class='with-sidebar menu-open'><article class='post'><h1>Mill</h1><p>{LONG}</p><p>{MORE}</p><p>End.</p></article></div></body>",
    "teasers": f"<body><div class='text'><h1>Mill</h1><p>{LONG}</p><p>{MORE}</p><p>{LONG}</p><p>{MORE}</p><p>End.</p></div><article class='card'><a href=/x>Another</a></article></body>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    want = ["Mill", LONG, MORE, "End."]
    if name == "teasers":
        want = ["Mill", LONG, MORE, LONG, MORE, "End."]
    assert html_text.main_text(LAYOUTS[name]).split("\n\n") == want


def test_markup():
    text = html_text.main_text
    page = "<article>%s</article>"
    assert text(page % "<p>a&nbsp;&amp;\n\t b&#8212;c &unknown; <b>bo</b>ld<br>next</p><script>var x='<p>no</p>';</script><style>p{}</style><!-- no <p>no --><p>&lt;b&gt;") == "a & b—c &unknown; bold next\n\n<b>"
    assert text(page % "<ul><li>one<li>two</ul><p><b>three<br><p>four</b> five") == "one\n\ntwo\n\nthree\n\nfour five"
    assert text(page % "loose <i>words</i><div>and</div> more") == "loose words\n\nand\n\nmore"
    assert text("<article><p>cut off <em>here") == "cut off here"
    assert text(page % "<p>one</p></section></div></p><p>two<template><p>no</p></template><p style='display: none'>no<p hidden>no") == "one\n\ntwo"
    assert text("just words, no markup at all") == "just words, no markup at all"
    assert [text(x) for x in ("", None, "<p></p>", "<nav>menu</nav>", "<", "<!--", "<script>x", "</p></p>")] == ["", "", "", "", "<", "", "", ""]
    deep = text("<div>" * 3000 + "<p>deep</p>" + "</div>" * 3000)
    assert deep == "deep"
    assert text(page % "".join(f"<p>line {i}</p>" for i in range(20_000))).count("\n\n") == 19_999


def test_smoothing():
    flat = html_text.smoothed(np.full(9, 5.0))
    assert np.allclose(flat, 5)
    assert html_text.content(np.array([0, 1, 0, 0, 0, 0, 90, 100, 80, 0, 0, 0.0])).tolist() == [False] * 6 + [True] * 3 + [False] * 3
    assert not html_text.content(np.zeros(4)).any()


def test_whole_table(spark, small):
    """Every page's text is its article's blocks, taken from the markup by patterns that fit this table alone."""
    want = {}
    for r in table(spark, small, "pages").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))]
        want[r["page_id"]] = (r["url"], "\n\n".join(b for b in blocks if b))
    got = {r["page_id"]: r for r in html_text.op12_html(spark, small).collect()}
    assert {k: (r["url"], r["text"]) for k, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_odd(spark):
    rows = [(1, "u", LAYOUTS["divs"]), (1, "u", LAYOUTS["divs"]), (None, None, None), (2, "u", ""), (3, None, "\x00�<p>é😀"), (4, "u", "<article>" + f"<p>{LONG}</p>" * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for df in (pages, pages.withColumns({"text": F.lit(1), "k0": F.lit(2), "t": F.lit(3), "n_chars": F.lit(4)})):
        got = html_text.extracted(df).collect()
        assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == sorted((i or 0, len(html_text.main_text(h))) for i, _, h in rows)
    assert html_text.extracted(pages.limit(0)).count() == 0
