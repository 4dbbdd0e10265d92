"""Main text of pages: the given pages against their articles, written pages with every kind of boilerplate, hostile markup."""

import html
import random
import re
import time

import numpy as np
import pytest

from fieldbook.llm import main_text as mt
from fieldbook.llm.shared import table

SCHEMA = "page_id bigint, url string, html string, text string, n_chars string, line int"
LONG = "A paragraph of the article that goes on for a while, with many words and hardly a tag, as they do."
STORY = f"<h1>The title</h1><p>{LONG}</p><p>Short.</p><p>{LONG} &amp; more</p><ul><li>one</li><li>two</li></ul><p>End.</p>"
WANT = f"The title {LONG} Short. {LONG} & more one two End."
NOISE = {
    "menu": '<nav><ul><li><a href="/">Home</a><li><a href="/b">Blog and much more than that</a></ul></nav>',
    "header": '<header><a href="/">The site</a> A slogan that is long enough to look like a sentence of a text.</header>',
    "sidebar": f'<div class="left sidebar"><h3>Latest</h3><p>{LONG}</p></div>',
    "aside": f"<aside><p>{LONG}</p></aside>",
    "cookies": f'<div id="cookie-notice">{LONG}<button>Accept</button></div>',
    "alert": f'<div role="alert">{LONG}</div>',
    "advert": f'<div class="ad">{LONG}</div>',
    "camel": f'<div class="adSlot">{LONG}</div>',
    "form": f'<form action="/x"><label>Mail</label><input name="q"><textarea>{LONG}</textarea><p>{LONG}</p></form>',
    "script": f'<script>var x = "<p>{LONG}</p>";</script><style>p {{ margin: 0 }}</style><noscript>{LONG}</noscript>',
    "comments": f'<section id="comments"><h2>2 comments</h2><article class="comment"><p>{LONG}</p></article><article class="comment"><p>Me too</p></article></section>',
    "hidden": f'<div style="display: none">{LONG}</div><p hidden>{LONG}</p>',
    "note": f"<!-- <p>{LONG}</p> -->",
    "footer": f"<footer>&copy; us <p>{LONG}</p></footer>",
}


def page(*parts):
    return "<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join(parts) + "</body></html>"


def test_given_pages(spark):
    """All pages of sf0.01: the article's blocks by plain text rules."""
    got = {r["page_id"]: r for r in mt.extract(table(spark, "/root/testdata/sf0.01", "pages")).collect()}
    for r in table(spark, "/root/testdata/sf0.01", "pages").collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        body = html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)>", "\x01", body))).replace("\x01", " ")
        text = " ".join(body.split())
        assert tuple(got[r["page_id"]]) == (r["page_id"], r["url"], text, len(text))


@pytest.mark.parametrize("around", ["<article>{}</article>", "<main>{}</main>", '<div class="layout has-sidebar"><div class="content">{}</div></div>', '<div><div class="x1">{}</div></div>'])
def test_boilerplate_goes(around):
    body = around.format(STORY)
    assert mt.main_text(page(body)) == WANT
    for name, noise in NOISE.items():
        assert mt.main_text(page(noise, body)) == WANT, name
        assert mt.main_text(page(body, noise)) == WANT, name
    assert mt.main_text(page(*NOISE.values(), body, *NOISE.values())) == WANT


def test_boilerplate_inside_the_article_goes():
    for name, noise in NOISE.items():
        if name != "header":
            half = STORY.index("<p>Short")
            assert mt.main_text(page("<article>", STORY[:half], noise, STORY[half:], "</article>")) == WANT, name


def test_article_inside_named_elements_stays():
    assert mt.main_text(page('<div class="page-header-banner"><div id="sidebar-layout"><article>', STORY, "</article></div></div>")) == WANT
    assert mt.main_text(page("<form>", STORY, "</form>")) == WANT
    assert mt.main_text(page("<article><header><h1>The title</h1></header>", STORY[len("<h1>The title</h1>") :], "</article>")) == WANT


def test_lines_without_names_fall_to_the_ratio():
    """No element says what it is: link lists have a low ratio."""
    links = "".join(f'<li><a href="{k}">Entry {k}</a></li>' for k in range(12))
    assert mt.main_text(page(f'<div class="q1"><ul>{links}</ul></div><div class="q2">{STORY}</div><div class="q3"><a href="1">imprint</a> <a href="2">privacy</a></div>')) == WANT


def test_blocks_and_white_space():
    assert mt.main_text(page("<article><p>in<script>x</script>one<span hidden>y</span>word <span class='ad'>z</span> b</p></article>")) == "inoneword b"
    assert mt.main_text(page("<article><h1>A\n\t b</h1><p>x<b>y</b>  z<br>w<p> </p><p>fi&shy;n &lt;b&gt; &#x41;&eacute;</p></article>")) == "A b xy z w fi­n <b> Aé"


def test_ratio_smoothing_and_threshold():
    lines, tree = mt.parse(page('<nav><a href="1">menu</a></nav>', f"<p>{LONG}</p><p>Short.</p><p>{LONG}</p>"))
    ratios, smoothed, content = mt.clusters(lines, mt.boilerplate(tree))
    assert [x.text for x in lines] == ["menu", LONG, "Short.", LONG] and ratios[0] == 0 and not content[0]
    assert content[1:].all() and ratios[1] == len(LONG) / lines[1].tags
    assert np.allclose(mt.smooth(np.array([0, 0, 1.0, 0, 0])).sum(), 1) and len(mt.smooth(np.ones(1))) == 1


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", " \n "), (3, "u", page("<article>", STORY, "</article>")), (3, "u", page("<article>", STORY, "</article>")), (4, "u", "plain words only"), (5, "u", page("<nav>only a menu</nav>"))]
    rows += [(6, "u", page("<article>", f"<p>{LONG}</p>" * 30_000, "</article>")), (7, "u", "<article><p>never closed"), (8, "u", "<p>a</p><p>a</p>"), (9, "u", "<![x[ y <p>text after it</p>"), (10, "u", "<p>a < b, b <c and <")]
    df = spark.createDataFrame([(*r, "t", "n", 1) for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in mt.extract(df).collect()), key=str)
    texts = {(r[0], r[2]) for r in got}
    assert len(got) == len(rows) and all(r[3] == len(r[2]) for r in got)
    assert {(1, ""), (2, ""), (None, ""), (3, WANT), (4, "plain words only"), (5, ""), (7, "never closed"), (8, "a a"), (10, "a < b, b")} <= texts
    assert (6, " ".join([LONG] * 30_000)) in texts
    assert mt.extract(df.limit(0)).collect() == [] and mt.line_ratios(df.where("page_id = 3")).where("kept").count() == 14


@pytest.mark.parametrize("part", ["<", "<a", "<a <", '<a href="', "<!--", "<![x[", "</", "<?", "&amp", "<div>x", "<b>x", "<p>x</b></i>", "<div><p></section>", "<title>"])
def test_hostile_markup_takes_linear_time(part):
    for end in ("", ">"):
        began = time.perf_counter()
        mt.main_text(part * 40_000 + end)
        assert time.perf_counter() - began < 5


def test_any_markup_is_survived():
    rng = random.Random(7)
    pieces = ["<p>", "</p>", "<article", ">", "<!", "<![CDATA[", "]]>", "-->", "<!--", "&#x110000;", "&", "text", '"', "'", "=", "<br/>", "</article>", "<script>", "</script>", "\0", "<td>", "<li>", "</div>", "<div class='ad'>"]
    for _ in range(400):
        assert isinstance(mt.main_text("".join(rng.choices(pieces, k=rng.randint(1, 40)))), str)
