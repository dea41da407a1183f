"""Cleaning, tokenising and chunking text with built-in functions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that cleaning leaves out.
STOP_WORDS = (
    "的", "了", "是", "在", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去",
    "你", "会", "着", "没有", "看", "好", "自己", "这",
)


#: Words in a dictionary that cuts text, at most.
MOST_WORDS = 10_000


def words(text: Column) -> Column:
    """The runs of characters other than white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def segmented(text: Column, dictionary: Sequence[str]) -> Column:
    """The text cut by a dictionary: at each place its longest word, or else a run of A-Z, a-z and digits or one character.

    For scripts without spaces. The dictionary is part of the plan, ``MOST_WORDS`` words at most.
    """
    return F.regexp_extract_all(text, F.lit(segments(dictionary)), F.lit(0))


def segments(dictionary: Sequence[str]) -> str:
    """The pattern whose matches are the segments: alternatives are tried from left to right."""
    words_ = sorted({w for w in dictionary if w}, key=lambda w: (-len(w), w))
    if len(words_) > MOST_WORDS:
        raise ValueError(f"a dictionary has {MOST_WORDS} words at most")
    return "|".join([*map(re.escape, words_), "[A-Za-z0-9]+", r"[^\s]"])


def clean(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Words between white space and punctuation, without stop words, joined by one space."""
    spaced = F.regexp_replace(text, r"[\s\p{P}]+", " ")
    stop = F.array(*[F.lit(w) for w in stop_words]).cast("array<string>")
    return F.array_join(F.filter(F.split(spaced, " "), lambda w: (w != "") & ~F.array_contains(stop, w)), " ")


def tokens(text: Column) -> Column:
    """Distinct lower-case words in the order of their first place."""
    return F.array_distinct(words(F.lower(F.trim(text))))


def characters(text: Column) -> Column:
    """Distinct characters in the order of their first place."""
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def chunks(text: Column, limit: int = 512) -> Column:
    """Words packed greedily: a chunk's words have ``limit`` bytes at most, the spaces between them apart.

    A longer word is a chunk of its own. The fold keeps the finished chunks, the open one and its size.
    """
    if limit <= 0:
        limit = 512
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("size"))

    def add(state: Column, word: Column) -> Column:
        n = F.octet_length(word)
        full = (state["size"] + n > limit) & (state["size"] > 0)
        return F.struct(
            F.when(full, F.array_append(state["done"], state["open"])).otherwise(state["done"]).alias("done"),
            F.when(full | (state["size"] == 0), word).otherwise(F.concat(state["open"], F.lit(" "), word)).alias("open"),
            F.when(full, n).otherwise(state["size"] + n).alias("size"),
        )

    return F.aggregate(
        words(text), empty, add, lambda s: F.when(s["size"] > 0, F.array_append(s["done"], s["open"])).otherwise(s["done"])
    )


def token_estimate(text: Column) -> Column:
    """Half the number of characters, rounded down."""
    return F.floor(F.length(text) / 2)


def html_text(html: Column) -> Column:
    """All text of a page but scripts and styles, with white space as single spaces."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    bare = F.regexp_replace(bare, r"(?s)<!--.*?-->|<[^>]*>", " ")
    for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(character))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def variable_byte_digits(n: Column) -> Column:
    """The variable-byte code of a number as text: groups of seven binary digits, each led by 0, the last by 1."""
    bits = F.bin(n)
    padded = F.lpad(bits, (F.ceil(F.length(bits) / 7) * 7).cast("int"), "0")
    groups = F.transform(F.sequence(F.lit(0), (F.length(padded) / 7).cast("int") - 1), lambda i: F.substr(padded, i * 7 + 1, F.lit(7)))
    return F.array_join(F.transform(groups, lambda g, i: F.concat(F.when(i == F.size(groups) - 1, F.lit("1")).otherwise(F.lit("0")), g)), "")
