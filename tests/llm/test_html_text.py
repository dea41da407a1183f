import html
import re

import pytest

from tessera.llm import html_text as h

P = "<p>A first paragraph that is long enough to be seen as text by any measure of it, with some words.</p>"
T = "A first paragraph that is long enough to be seen as text by any measure of it, with some words."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain", "plain"),
        (f"<nav><a href=/>Home</a></nav>{P}<p>B.</p><footer>&copy; me</footer>", f"{T}\nB."),
        (f"<header>Site</header><article><header><h1>Title</h1></header>{P}<div class='ad'>Buy!</div><p>Short.</p></article><aside>Else, {T}</aside>", f"Title\n{T}\nShort."),
        (f"<article>{P}<section class='comments'><p>{T} I say.</p></section></article>", T),
        (f"<div id=cookie-notice>{T}</div><main>{P}<form><label>Name</label></form></main>", T),
        ("<article><p>x &amp; y &lt;b&gt;&nbsp;&eacute;<br>z\n\n w</p><p> </p><b>u<p>v</article>", "x & y <b> é z w\nu\nv"),
        ("<article><p>cut &am</p><p>more &amp", "cut &am\nmore &"),
        ("<article><p>one<script>var t='</p>';</script> two</p><!-- <p>no</p> --><style>p{}</style></article>", "one two"),
        ("<article><p>open <a href='x", "open"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</tr></table></article>", "one\ntwo\na b"),
        (f"<ul><li><a href=a>one two three</a></li></ul><div>{T}</div><ul><li><a href=b>four five</a></ul>", T),
        ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
        ("<title>T</title><article></article><footer>F</footer>", ""),
    ],
)
def test_main_text(page, text):
    assert h.main_text(page) == text


def test_stretches():
    assert h.stretches([0, 50, 40, 0, 0, 30, 0, 0, 0, 0, 10, 0], window=3, surge=80) == [(1, 6)]
    assert h.stretches([5, 0, 0, 0, 0, 9], window=3, surge=80) == [(5, 6)]
    assert h.stretches([], surge=1) == []


def test_long_broken_pages_take_linear_time():
    for page in ("<a \"" * 30_000, "<" * 200_000, "<script>" * 20_000, "<!--" * 50_000, "<p title='x" * 20_000, "<div>" * 30_000 + "</p>" * 30_000):
        h.main_text(page)


def test_query_over_the_whole_table(spark, sf):
    pages = {p.page_id: p for p in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = h.op6_html_text(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r.page_id].html, re.S)[1]
        inner = re.sub(r"</?(?:b|br)>", "", inner)
        want = "\n".join(x for x in (" ".join(html.unescape(t).split()) for t in re.split(r"</?(?:p|h1)>|<[a-z/]*\Z", inner)) if x)
        assert (r.text, r.n_chars, r.url) == (want, len(want), pages[r.page_id].url)


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, "a"), (1, P, "b"), (1, P, "b")], "page_id long, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in h.extract(df).collect()) == [(0, ""), (1, T), (1, T)]
    assert h.extract(df.limit(0)).count() == 0
