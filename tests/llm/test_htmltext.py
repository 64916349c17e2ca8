"""Main text of pages: made-up sites with known articles, and the table's own pages."""

from __future__ import annotations

import html
import re

import pytest
from pyspark.sql import functions as F

from accountlens.llm import htmltext, queries
from accountlens.llm.htmltext import Page

SCHEMA = "page_id long, url string, html string"


def text_of(source: str, template=frozenset()) -> str:
    return Page(source).text(template)[0]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a<p>b</p>c", "a\n\nb\n\nc"),
        ("<div>a <b>b</b>\n\tc&nbsp;d<br>e</div>", "a b c d e"),
        ("<p><b>bold<br><p>next</p>", "bold\n\nnext"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\n\nb\n\nc\n\nd"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\n\nc"),
        ("<script>var t='</p><p>no';</script><style>p{}</style>x<!-- <p>no -->y", "xy"),
        ("<article><p>1 < 2 &lt; 3 & 4 &am &amp</p></article>", "1 < 2 < 3 & 4 &am &"),
        ("<article><header><h1>T</h1></header><p>a</p><footer>f</footer></article><p>out</p>", "T\n\na"),
        ("<header>h</header><main><p>a</p><aside>s</aside><form>f<input></form></main>x", "a"),
        ("<div class='cookie-notice'>c</div><div id=sideBar>s</div><div class=content>a</div><div role=contentinfo>z</div>", "s\n\na"),
        ("<div id=sidebar>s</div><div class='wrap has-sidebar'><article>a</article></div>", "a"),
        ("<article>a</article><section class=comments><article class=comment>c</article></section>", "a"),
        ("<article class='comment'>c</article><div>d</div>", "d"),
        ('<p title="a > b" data-x=\'>\'>in</p>', "in"),
        ("<p title=don't>in</p><p>it's</p>", "in\n\nit's"),
        ("<nav><ul><li>menu</ul><p>still menu</nav><p>a", "a"),
        ("<b><div>a</b>b</div>c", "ab\n\nc"),
        ("<article><p>a", "a"),
        ("<article><p>a</article", "a"),
        ("<textarea><p>no</textarea><noscript>no</noscript><p>a</p></p></div>b", "a\n\nb"),
        ("<title>no</title><article>&#65;&#x42;&eacute;</article>", "ABé"),
        ("<div>" * 5000 + "deep", "deep"),
        ("<b>" * 5000 + "<p>deep</p>", "deep"),
        ("<a " * 3000, ""),
    ],
)
def test_pages(source, want):
    assert text_of(source) == want


def site(n: int, host: str, article: bool) -> list:
    rows = []
    for i in range(n):
        body = f"<h1>Title {i}</h1><p>Own words of page {i}, and more.</p><p>A passage that all pages of this site quote.</p>"
        if article:
            body = f"<article>{body}<div class=x><a href=/a>Read this</a> <a href=/b>and that</a> now</div></article>"
        else:
            body = f"<div><h1>Title {i}</h1><p>Own words of page {i}, and more.</p></div>"
        rows.append((f"https://{host}/p{i}", f"<html><body><div class=q{i}><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></div>{body}<div><p>Our address is here.</p><span>{i}</span></div></body></html>"))
    return rows


def test_what_a_site_repeats_goes_and_prose_of_articles_stays(spark):
    rows = site(6, "one.example", True) + site(6, "TWO.example:80", False) + site(2, "few.example", False)
    rows += [(rows[0][0], rows[0][1])] * 3 + [(None, "<p>Our address is here.</p>"), ("https://one.example/x", None), ("nothing", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA).withColumn("text", F.lit(1)).withColumn("host", F.lit("y"))
    got = {r.page_id: r for r in htmltext.main_text(df).collect()}
    assert len(got) == len(rows)
    for i in range(6):
        assert got[i].text == f"Title {i}\n\nOwn words of page {i}, and more.\n\nA passage that all pages of this site quote."
        assert got[6 + i].text == f"Title {i}\n\nOwn words of page {i}, and more.\n\n{i}"
        assert got[6 + i].n_template == 2
    assert got[12].text == "Home\n\nNews\n\nTitle 0\n\nOwn words of page 0, and more.\n\nOur address is here.\n\n0"
    assert got[14].text == got[0].text
    assert got[17].text == "Our address is here."
    assert (got[18].text, got[19].text, got[18].n_chars) == ("", "", 0)


def test_copies_of_a_page_are_no_template(spark):
    page = "<div><p>The whole story.</p></div>"
    rows = [(i, f"https://a.example/{i}", page) for i in range(9)]
    assert {r.text for r in htmltext.main_text(spark.createDataFrame(rows, SCHEMA)).collect()} == {"The whole story."}


def test_templates_by_broadcast_or_by_host(spark, monkeypatch):
    rows = [(i, *r) for i, r in enumerate(site(30, "hot.example", False) + [x for k in range(5) for x in site(4, f"h{k}.example", False)])]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, htmltext.main_text(df).collect()))
    monkeypatch.setattr(htmltext, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, htmltext.main_text(df).collect())) == want


def test_no_rows(spark):
    assert htmltext.main_text(spark.createDataFrame([], SCHEMA)).collect() == []


def plain(source: str) -> str:
    """The article of the table's pages, whose markup is simple."""
    inner = re.search("<article>(.*?)(</article>|$)", source, re.S).group(1)
    blocks = (" ".join(html.unescape(re.sub("</?b>", "", b).replace("<br>", " ")).split()) for b in re.split("</?(?:h1|p)>", inner))
    return "\n\n".join(b for b in blocks if b)


def test_query(spark, sf_dir):
    want = {r.page_id: (r.url, plain(r.html)) for r in queries.table(spark, sf_dir, "pages").collect()}
    got = queries.op13_html(spark, sf_dir).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)
    assert all(r.n_template + r.n_marked > 0 for r in got)
