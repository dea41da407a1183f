import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import html_text as h

T = "A first paragraph that is long enough to be seen as text by any measure of it, with some words."
U = "A second paragraph, which says something else at about the same length as the one before it did."
P, Q = f"<p>{T}</p>", f"<p>{U}</p>"


@pytest.mark.parametrize("name", ["content no-sidebar", "post has-comments", "layout with-sidebar", "entry related-article-body", "article-share-wrap", "alert-news main-copy", "sidebar"])
@pytest.mark.parametrize("mark", ["", "article"])
def test_class_names_around_the_text_never_delete_it(name, mark):
    inner = f"<div class=\"{name}\">{P}{Q}</div>"
    page = f"<nav><a href=/>Home</a></nav><{mark}>{inner}</{mark}><footer>f</footer>" if mark else inner
    assert h.main_text(page) == f"{T}\n{U}"


@pytest.mark.parametrize("name", ["ad", "comments", "comment-list", "related-posts", "share-buttons", "cookieNotice", "newsletter-signup", "sidebar widget"])
@pytest.mark.parametrize("mark", ["article", "div"])
def test_named_boxes_beside_the_text_go(name, mark):
    assert h.main_text(f"<{mark}>{P}<div class=\"{name}\"><p>{U} {U}</p><p>{T}</p></div><p>Short.</p></{mark}>") == f"{T}\nShort."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"{P}<p><a href=x>{U}</a></p>{P}", f"{T}\n{U}\n{T}"),
        (f"<article>{P}<p><a href=x>{U}</a></p></article>", f"{T}\n{U}"),
        (f"<article><p>one <button>press</button> two</p>{P}</article>", f"one two\n{T}"),
        (f"{P}<ul><li><a href=1>a</a><li><a href=2>b</a></ul>{Q}", f"{T}\n{U}"),
        (f"{P}<nav>" + "<li><a href=1>a</a>" * 9 + "</nav><p>Short.</p>", f"{T}\nShort."),
        (f"<article><p>tiny</p></article><div>{T * 20}</div>", "tiny"),
        (f"<p>Kept alone.</p><div class=ad>{U}</div>", "Kept alone."),
    ],
)
def test_pages_without_and_with_marks(page, text):
    assert h.main_text(page) == text


def test_without_windows_real_pages_differ(spark, sf):
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    with_advert = [p for p in pages if re.search(r"<div class=.ad.>[^<]", p)]
    assert with_advert
    for p in with_advert:
        advert = h._html.unescape(" ".join(re.search(r"<div class=.ad.>([^<]+)", p)[1].split()))
        assert h.main_text(p, window=0) != h.main_text(p)
        assert advert in h.main_text(p, window=0).split("\n") and advert not in h.main_text(p).split("\n")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 5, 30, 90]), max_size=30), st.integers(1, 5), st.sampled_from([1, 40, 80]))
def test_stretches_are_those_of_the_windows(weights, window, surge):
    # Brute force: a line with weight belongs with the next one unless a whole window between them is empty.
    groups = []
    for i, x in enumerate(weights):
        if x:
            empty = groups and any(not any(weights[j : j + window]) for j in range(groups[-1][-1] + 1, i - window + 1))
            if groups and not empty:
                groups[-1].append(i)
            else:
                groups.append([i])
    want = [(g[0], g[-1] + 1) for g in groups if any(sum(weights[i : i + window]) >= surge for i in range(g[0], g[-1] + 1))]
    assert h.stretches(weights, window, surge, heaviest=False) == want


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, P, "u", 3, "t")], "page_id long, html string, url string, n_chars int, _html string")
    assert [tuple(r) for r in h.extract(df, keep=("url",)).collect()] == [(1, "u", T)]
