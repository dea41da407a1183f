"""Main text of web pages by line-block distribution.

Markup is stripped so that every block element is a line. A line weighs its length. Where it stands
in a menu, header, footer, sidebar, form or hidden element, as tags and roles say, or is mostly
links, it weighs nothing; where class names only suggest that, it weighs less; where the page marks
its article, its lines weigh ``MARK`` more. Lines that marks or hints set apart are a region of
their own. Along the lines of each region, sums of weights over sliding windows show where text surges and
where it dives back to nothing; the lines between a surge and its dive are the page's text.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import batches
from tessera.sources.tables import table

#: Lines in a window, and the weight at which a window's sum counts as a surge.
WINDOW, SURGE = 3, 80
#: What a line of a marked article weighs more; on such pages a surge is an eighth of it.
MARK = 1_000_000
#: Factors of weight where a class name as a whole, or in part, names something other than the article.
NAMED, HINTED = 0.001, 0.5
#: A line outside the article with a larger share of its characters inside links has no weight.
LINKED = 0.5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|select|iframe|object|canvas|title)\b[^>]*+(?:>.*?(?:</(?P=raw)\s*+>|\Z)|\Z)"
    r"|<(?P<drawing>svg|math)\b(?P<empty>[^>]*+)(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[a-zA-Z/!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead tr ul".split()
)
#: What a head may hold besides the elements that are dropped whole; anything else begins the body.
_HEAD = frozenset("html head base basefont bgsound link meta".split())
_HEAD_END = re.compile(r"</head\s*+>", re.I)
_DRAWING_END = {x: re.compile(rf"</{x}\s*+>", re.I) for x in ("svg", "math")}
_HREF = re.compile(r"(?:^|[\s\"'/])href\s*=", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no part of an article, and those that do even if named like one that doesn't.
_ASIDE = frozenset("nav aside footer form menu dialog search".split())
_ARTICLE = frozenset(["article", "main"])
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Parts of class names that say what else than an article an element holds, and those that say nothing.
_OTHERS = frozenset(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert newsletter"
    " subscribe subscription signup sidebar widget widgets related recommended recommendations share sharing social breadcrumb breadcrumbs menu nav"
    " navbar navigation footer masthead topbar comment comments commentlist respond disqus replies popup modal overlay login pagination pager toolbar hidden".split()
)
_NEUTRAL = frozenset(
    "area bar block bottom box button buttons card cards col column container footer form global group header inner item items left lg link links list"
    " md message module outer page panel posts primary right row secondary section site slot sm stories thread top unit wrap wrapper".split()
)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_PAGE_HEADERS = frozenset("header site-header site_header page-header page_header main-header main_header top-header top_header".split())
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")


@dataclass
class Line:
    text: str
    weight: float
    in_article: bool
    region: int


def _factor(name: str, attrs: str, in_article: bool) -> float:
    """What the weight of an element's lines is multiplied by: 0 if it holds something other than the article."""
    if name in _ASIDE or name == "button" or (name == "header" and not in_article):
        return 0
    if not attrs.strip(" /\t\r\n") or name in ("html", "body", "article", "main"):
        return 1
    factor = 1.0
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), a or b or c
        if key in ("class", "id"):
            for word in value.split():
                parts = {x.lower() for x in _PARTS.findall(word) if not x.isdigit()}
                if not in_article and word.lower() in _PAGE_HEADERS or parts & _OTHERS and parts <= _OTHERS | _NEUTRAL:
                    factor = min(factor, NAMED)
                elif parts & _OTHERS:
                    factor = min(factor, HINTED)
        if key == "hidden" or (key == "role" and value.lower() in _ROLES) or (key == "aria-hidden" and value.lower() == "true"):
            return 0
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 0
    return factor


def lines(page: str) -> list[Line]:
    """The page's blocks in order, with white space inside a block as one space; empty ones left out."""
    out: list[Line] = []
    text: list[str] = []
    open_: list[tuple[str, float, int, bool]] = []  # name; factor and region of its parent; whether it is the article
    count: Counter[str] = Counter()  # of the names in open_
    factor, region, regions = 1.0, 0, 0
    articles = linked = 0
    full: list[float] = []  # for each line, its weight if links are left aside
    link = -1  # the line in which the open link began
    hidden = ""  # head, svg or math while its text is dropped
    head_end: int | None = None  # where the page's last </head> is
    none_after: dict[str, bool] = {}  # drawings that are known to have no end from here on

    def end_line() -> None:
        nonlocal linked
        joined = " ".join(_html.unescape("".join(text)).split())
        if joined:
            full.append(factor * (len(joined) + MARK * (articles > 0)))
            menu = not articles and linked > LINKED * sum(map(len, text))
            out.append(Line(joined, 0 if menu else full[-1], articles > 0, region))
        text.clear()
        linked = 0

    def unclosed() -> None:
        """The open link has no end: it holds no more than the line in which it began."""
        nonlocal link, linked
        if 0 <= link < len(out):
            for i in range(link + 1, len(out)):
                out[i].weight = full[i]
            linked = 0
        link = -1

    def close() -> str:
        nonlocal factor, region, articles
        last, factor, region, article = open_.pop()
        count[last] -= 1
        articles -= article
        return last

    def shown(piece: str) -> bool:
        nonlocal hidden
        if hidden == "head" and piece.strip() and at > head_end:
            hidden = ""  # text that no end of the head follows begins the body
        return not hidden and not count["button"]

    at = 0
    while m := _TOKEN.search(page, at):
        piece = page[at : m.start()]
        if piece and shown(piece):
            text.append(piece)
            if link >= 0:
                linked += len(piece.strip())
        at = m.end()
        if drawing := (m["drawing"] or "").lower():
            if not m["empty"].endswith("/") and not hidden:
                end = None if none_after.get(drawing) else _DRAWING_END[drawing].search(page, at)
                if end:
                    at = end.end()
                else:
                    none_after[drawing], hidden = True, drawing
            continue
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["close"]:
            if name == "head" and hidden == "head":
                hidden = ""
            if name in _BLOCKS:
                hidden = hidden if hidden == "head" else ""
                end_line()
            if name == "a":
                link = -1
            if count[name]:
                while close() != name:
                    pass
            continue
        if name == "head" and count["html"] == len(open_) and not hidden and not out:
            hidden = "head"
            head_end = max((x.start() for x in _HEAD_END.finditer(page)), default=-1)
        elif hidden == "head" and name not in _HEAD or hidden and name in _BLOCKS:
            hidden = ""
        if name in ("br", "td", "th"):
            text.append(" ")
        if name in _BLOCKS:
            end_line()
        if name == "a":
            unclosed()
            if _HREF.search(m["attrs"]):
                link = len(out)
        if name in _VOID or m["attrs"].endswith("/"):
            continue
        if name in _BLOCKS or name in ("span", "ins", "button"):
            if name == "p" and open_ and open_[-1][0] == "p" or name == "li" and open_ and open_[-1][0] == "li":
                close()  # these end where the next begins
            own, article = _factor(name, m["attrs"], articles > 0), name in _ARTICLE
            open_.append((name, factor, region, article))
            count[name] += 1
            articles += article
            if own < 1:
                regions += 1
                region = regions
            factor = min(factor, own)
    if at < len(page) and shown(page[at:]):
        text.append(page[at:])
    end_line()
    unclosed()
    return out


def stretches(weights: list[float], window: int = WINDOW, surge: float = SURGE, heaviest: bool = True) -> list[tuple[int, int]]:
    """(surge, dive) for each stretch of lines: from the first line of a window whose sum reaches
    ``surge`` to the line after which a whole window is empty. Both ends have weight. Where no window
    reaches it, the stretches with the largest sum count if ``heaviest``."""
    runs, start, last = [], None, -1
    for i, x in enumerate(weights):
        if not x:
            continue
        if start is None or i - last > window:
            if start is not None:
                runs.append((start, last + 1))
            start = i
        last = i
    if start is not None:
        runs.append((start, last + 1))
    high = [(a, b) for a, b in runs if max(sum(weights[i : i + window]) for i in range(a, b)) >= surge]
    if high or not runs or not heaviest:
        return high
    most = max(sum(weights[a:b]) for a, b in runs)
    return [(a, b) for a, b in runs if sum(weights[a:b]) == most]


def main_text(page: str, window: int = WINDOW) -> str:
    """The main text of a page: its lines between surge and dive, joined by a newline.

    A line of links in the middle of a stretch stays if it stands alone; several in a row are a menu.
    Where no window reaches a surge, the heaviest stretch counts. ``window`` 0 keeps every line that
    has weight, without the distribution.
    """
    found = lines(page)
    if not window:
        return "\n".join(x.text for x in found if x.weight)
    by_region: dict[tuple[int, bool], list[int]] = {}
    for i, x in enumerate(found):
        by_region.setdefault((x.region, x.in_article), []).append(i)
    surge = MARK / 8 if any(x.in_article and x.weight for x in found) else SURGE

    runs = []
    for heaviest in (False, True):
        for places in by_region.values():
            weights = [found[i].weight for i in places]
            runs += [(sum(weights[a:b]), places[a:b]) for a, b in stretches(weights, window, surge, heaviest)]
        if runs:
            break
    else:
        return ""
    if heaviest:
        most = max(x for x, _ in runs)
        runs = [x for x in runs if x[0] == most]
    stay = []
    for _, run in runs:
        stay += [i for k, i in enumerate(run) if found[i].weight or (found[run[k - 1]].weight and found[run[k + 1]].weight)]
    return "\n".join(found[i].text for i in sorted(stay))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns of ``keep`` and ``text``: one row per row of ``pages``.

    Character references are decoded; comments, scripts, styles and the head are never text; markup
    that breaks off at the end of a page is dropped. A null or empty page has the empty text. Null
    ids and repeated rows stay; columns not in ``keep`` are ignored whatever their names.
    """
    rows = pages.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], F.col(html_col).cast("string").alias("_html"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches.pieces(parts, "_html"):
            text = pa.array(list(map(main_text, batches.texts(part, "_html"))), pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], text], [*part.schema.names[:-1], "_html"])

    out = rows.mapInArrow(read, ", ".join([*kinds, "_html string"]))
    return out.select(F.col("_id").alias(id_col), *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], F.col("_html").alias("text"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), keep=("url",)).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op6_html_text": op6_html_text}
