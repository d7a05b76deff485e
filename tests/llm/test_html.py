"""Main text of pages: parsing, the minimum cut against all labellings, held-out layouts and awkward rows."""

import html
import itertools
import random
import re

import numpy as np
import pytest

from carepath.llm import html_blocks as hb
from carepath.llm import html_mincut as hm
from carepath.llm.queries import op12_html_text
from tests.conftest import SF_SMALL
from tests.llm.helpers import rows_of, with_extra


@pytest.fixture(scope="module")
def weights(spark):
    return hm.default_weights(spark)


def lines(page):
    return [b.text for b in hb.parse(page).blocks]


def test_blocks_of_broken_and_odd_markup():
    assert lines("") == [] and lines(" \n<p> </p>&nbsp;") == []
    assert lines("plain  text &amp; more &lt;b&gt; a < b &copy; &#228;&am") == ["plain text & more <b> a < b © ä&am"]
    assert lines("<p><b>one<br>two<p>three</b> four</p>five") == ["one two", "three four", "five"]
    assert lines("<ul><li>a<li>b<ul><li>c</ul>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert lines('<script>var t="</p>";</script><style>p{}</style><title>t</title><p>x') == ["x"]
    assert lines("<SCRIPT>a</ScRiPt >b<!-- c --><!--> d <!-- e") == ["b d"]
    assert lines("<p>İ<script>İ</script>after</p>") == ["İafter"]
    assert lines("<p>a<select><option>x</select>b<button>c</button>d</p>") == ["abd"]
    assert lines("<a title='x > y' href=/a?b=c>link</a><p class=\"unclosed>text</p>") == ["link", "text"]
    assert lines("<table><tr><td>a<td>b<tr><th>c</table><h2>d<h3>e</h2>f") == ["a", "b", "c", "d", "e", "f"]
    assert lines("</div></p>a</div>b<hr>c<") == ["a", "b", "c<"]


def test_long_pages_parse_in_one_pass():
    assert len(lines("<div>" * 20_000 + "x" + "</p>" * 20_000)) == 1
    assert len(lines("<p>word " * 100_000)) == 100_000
    assert lines('<a "' * 50_000) == []


def test_cut_is_the_cheapest_labelling():
    rng = random.Random(4)
    for _ in range(150):
        n = rng.randint(1, 8)
        terminal = [rng.randint(-6, 6) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randint(0, 5)) for _ in range(rng.randint(0, 14))]
        net = hm.Network(terminal)
        for a, b, c in edges:
            net.join(a, b, c)
        side = net.source_side()

        def cost(s):
            own = sum(max(t, 0) if not x else max(-t, 0) for x, t in zip(s, terminal))
            return own + sum(c for a, b, c in edges if s[a] != s[b])

        assert cost(side) == min(cost(s) for s in itertools.product([False, True], repeat=n))


def test_long_chain_of_blocks():
    net = hm.Network([50] + [0] * 20_000 + [-30])
    for i in range(20_001):
        net.join(i, i + 1, 40)
    assert all(net.source_side()[:-1]) and net.rest[0] == 20


def test_smoothness_keeps_short_lines_of_prose_and_drops_menus(weights):
    prose = "<p>The river passed the old market, and the morning was silver over the glass harbour.</p>"
    page = f'<div><a href="/a">Home</a> <a href="/b">News</a></div><div>{prose * 3}<p>Of</p>{prose * 3}</div>'
    got = hm.main_text(page, weights).split("\n")
    assert len(got) == 7 and got[3] == "Of"


def test_layouts_that_the_labelled_table_does_not_hold(weights):
    p = "<p>Seven letters came by the winter bridge, and nobody in the garden could read them.</p>"
    text = p[3:-4]
    cases = [
        f'<body class="has-sidebar"><div id="wrap"><article><header class="entry-header"><h1>Big</h1></header>{p}<aside><p>{text}</p></aside></article></div>',
        f'<div class="sidebar-layout"><main><h1>Big</h1>{p}</main><div class="widget">{p}</div></div>',
        f'<form id="aspnet"><nav>{p}</nav><article><h1>Big</h1>{p}</article></form><section class="comments"><article>{p}</article></section>'.replace("<article><p>", '<article class="comment"><p>', 1),
        f'<div role="navigation">{p}</div><div role="main"><h1>Big</h1>{p}</div><div role="contentinfo">{p}</div>',
        f'<div class="advert">{p}<article><h1>Big</h1>{p}</article>',
        f'<article><h1>Big</h1>{p}</article><aside><article><h3>Other</h3>{p}</article></aside>',
        f'<main><h1>Big</h1>{p}<div class="related"><article>{p}</article></div></main><footer><article>{p}</article></footer>',
        f'<div id="cookieConsent">{p}</div><div class="post-body"><h1>Big</h1>{p}</div><ul class="share-links"><li>{text}</li></ul>',
    ]
    for page in cases:
        assert hm.main_text(page, weights).split("\n") == ["Big", text], page


def test_held_out_pages(weights):
    for i in range(5000, 5300):
        page, text = hb.example_page(i)
        assert hm.main_text(page, weights) == text


def test_query_equals_the_article(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    got = op12_html_text(spark, SF_SMALL).collect()
    assert len(got) == len(pages)
    for r in got:
        inside = re.search("<article>(.*)</article>", pages[r.page_id].html, re.DOTALL).group(1)
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inside)]
        assert r.text == "\n".join(x for x in parts if x)
        assert (r.url, r.n_chars) == (pages[r.page_id].url, len(r.text))


def test_awkward_rows(spark, weights):
    page, text = hb.example_page(3)
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "v", ""), (None, "w", page), (4, "x", "<nav>a</nav>" * 3)]
    rows += [(5, "y", "<article>" + "<p>So the river ran on.</p>" * 60_000 + "</article>")]
    pages = with_extra(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {(r.page_id, r.url): r for r in hm.extract(pages, weights).collect()}
    assert hm.extract(pages, weights).count() == len(rows)
    assert got[1, "u"].text == got[None, "w"].text == text and got[1, "u"].n_chars == len(text)
    assert got[2, None].text == got[3, "v"].text == got[4, "x"].text == ""
    assert got[5, "y"].n_chars == 60_000 * 21 - 1
    assert rows_of(hm.extract(pages.limit(0), weights)) == []


def test_labelled_pages_are_bounded(spark, monkeypatch):
    assert np.array_equal(hm.fit(hb.labelled_pages(spark)), hm.fit(hb.labelled_pages(spark).repartition(3)))
    monkeypatch.setattr(hm, "MAX_LABELLED", 10)
    with pytest.raises(ValueError):
        hm.fit(hb.labelled_pages(spark, 2))
