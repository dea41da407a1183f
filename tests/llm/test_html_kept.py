import time

import pytest

from tessera.llm import html_text as h

T = "A first paragraph that is long enough to be seen as text by any measure of it, with some words."
P = f"<p>{T}</p>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><h1><a href=/x>Title</a></h1>{P}<ul><li><a href=a>Source one</a><li><a href=b>Source two</a></ul></article>", f"Title\n{T}\nSource one\nSource two"),
        (f"<article>{P}<a name=top><p>One.</p><p>Two.</p></article>", f"{T}\nOne.\nTwo."),
        (f"<a name=top>{P}{P}", f"{T}\n{T}"),
        (f"<div><a href=/>Home</div>{P}{P}", f"{T}\n{T}"),
        (f"<div><a href=/>Home</div>{P}<ul><li><a href=b>two</a></ul>", T),
        (f"<a href=/x><div><p>{T}</p></div></a><p>{T} More.</p>", f"{T} More."),
        (f"<html><head><meta charset=utf-8><title>No</title><body>{P}", T),
        (f"<head><title>No</title>{P}", T),
        (f"<head><title>No</title>{T}", T),
        (f"<head><script>'<p>no'</script><title>No</title> no </head><body>{P}", T),
        (f"<!doctype html><html lang=en><head>no</head><body>{P}</body></html>", T),
        (f"<article><svg viewBox='0 0 1 1'/>{P}</article>", T),
        (f"<article><math/>{P}<svg><title/><text>no</text></svg><p>Two.</p></article>", f"{T}\nTwo."),
        (f"<article><p><svg><text>no</text></p>{P}</article>", T),
    ],
)
def test_kept(page, text):
    assert h.main_text(page) == text


def test_linear_time():
    start = time.monotonic()
    for page in ("<svg><p>" * 30_000, "<svg>" * 30_000, "<svg></svg>" * 30_000, "<head>" * 30_000, "<a href=x><p>t</p>" * 20_000, "<math><p><svg><p>" * 20_000):
        h.main_text(page)
    assert time.monotonic() - start < 20
