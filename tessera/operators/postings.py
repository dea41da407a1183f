"""Keyword search: postings as a table, boolean queries as joins of id sets."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import bits as B
from tessera.functions import text as T


def build(
    docs: DataFrame, text_cols: dict[str, str], id_col: str = "doc_id", bits: Column | None = None, tokens=T.tokens, only: Iterable[str] | None = None
) -> DataFrame:
    """``doc_id``, ``field``, ``word``, ``bits``: one row per document, field and distinct word.

    ``text_cols``: field names by column. Documents with a null id have no postings. ``only``: the few
    words that a query asks about; others are left out before any row is made of them. To search
    again and again, write the postings of all words.
    """

    def keywords(c: str, name: str) -> Column:
        found = F.coalesce(tokens(F.col(c)), F.array().cast("array<string>"))
        if only is not None:
            asked = sorted(set(only))
            found = F.filter(found, lambda w: w.isin(asked))
        return F.transform(found, lambda w: F.struct(F.lit(name).alias("field"), w.alias("word")))

    lists = [keywords(c, f) for c, f in text_cols.items()]
    keyword = F.explode(F.concat(*lists) if len(lists) > 1 else lists[0])
    mask = F.lit(0).cast("long") if bits is None else bits
    out = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), mask.alias("bits"), keyword.alias("k")).select("doc_id", "k.field", "k.word", "bits")
    # ``tokens`` gives a column's words once each; only columns that share a field can repeat one.
    return out if len(set(text_cols.values())) == len(text_cols) else out.distinct()


@dataclass(frozen=True)
class Term:
    """A boolean query: a keyword, or all of ``must``, or any of ``should``; in that order of precedence."""

    field: str = ""
    word: str = ""
    must: tuple[Term, ...] = ()
    should: tuple[Term, ...] = ()

    def empty(self) -> bool:
        return not self.word and not self.must and not self.should

    def also(self, *others: Term) -> Term:
        """This and all others; empty ones don't count."""
        return _one_of([x for x in (self, *others) if not x.empty()], "must")

    def either(self, *others: Term) -> Term:
        """This or any other; empty ones don't count."""
        return _one_of([x for x in (self, *others) if not x.empty()], "should")

    def __str__(self) -> str:
        if self.word:
            return f"{self.field}\u0001{self.word}"
        if self.must:
            return "(" + "&".join(map(str, self.must)) + ")"
        return "(" + "|".join(map(str, self.should)) + ")" if self.should else ""

    def keywords(self) -> set[tuple[str, str]]:
        if self.word:
            return {(self.field, self.word)}
        return set().union(*(t.keywords() for t in (self.must or self.should)))


def _one_of(terms: list[Term], kind: str) -> Term:
    return terms[0] if len(terms) == 1 else Term(**{kind: tuple(terms)}) if terms else Term()


def _truth(q: Term, has: dict[tuple[str, str], Column]) -> Column:
    if q.word:
        return has[(q.field, q.word)]
    parts = [_truth(t, has) for t in (q.must or q.should)]
    return reduce(Column.__and__ if q.must else Column.__or__, parts)


def search(postings: DataFrame, q: Term, on: int = 0, off: int = 0, any_of: tuple[int, ...] = ()) -> DataFrame:
    """``doc_id`` of the documents that satisfy ``q`` and the bit masks, once each.

    The query's keywords filter the postings where they are read; one aggregation by document then
    evaluates the whole tree. An unknown keyword is false; the empty query finds nothing.
    """
    keys = sorted(q.keywords()) if not q.empty() else []
    if not keys:
        return postings.select("doc_id").limit(0)
    match = [(F.col("field") == f) & (F.col("word") == w) for f, w in keys]
    rows = postings.where(reduce(Column.__or__, match)).where(B.passes(F.col("bits"), on, off, any_of))
    flags = [F.max(F.when(m, True).otherwise(False)).alias(f"k{i}") for i, m in enumerate(match)]
    has = {k: F.col(f"k{i}") for i, k in enumerate(keys)}
    return rows.groupBy("doc_id").agg(*flags).where(_truth(q, has)).select("doc_id")


def hits(postings: DataFrame, words: list[str]) -> DataFrame:
    """``doc_id`` and ``n_hits``: how many distinct words of the query a document has, in any field."""
    some = postings.where(F.col("word").isin(sorted(set(words))))
    return some.groupBy("doc_id").agg(F.count_distinct("word").alias("n_hits"))


def with_prefix(postings: DataFrame, prefix: str) -> DataFrame:
    """The distinct words that begin with ``prefix``; a filter that Parquet can skip row groups by."""
    return postings.where(F.col("word").startswith(prefix)).select("word").distinct()


def known_words(text: DataFrame, dictionary: DataFrame, word: str = "word") -> DataFrame:
    """The rows of ``text`` whose word is in the dictionary."""
    return text.join(dictionary.select(word).distinct(), word, "left_semi")


def by_score_id(postings: DataFrame, docs: DataFrame, score_id: int) -> DataFrame:
    """The document with a score id, and its keywords in order."""
    doc = docs.where(F.col("score_id") == score_id)
    words = postings.join(doc.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id")
    return doc.join(words.agg(F.array_sort(F.collect_list(F.struct("field", "word"))).alias("keywords")), "doc_id", "left")


def intersection(lists: list[DataFrame], id_col: str = "doc_id") -> DataFrame:
    """The ids that all lists have."""
    tagged = [d.select(id_col, F.lit(i).alias("_list")) for i, d in enumerate(lists)]
    both = reduce(DataFrame.unionByName, tagged)
    return both.groupBy(id_col).agg(F.count_distinct("_list").alias("_n")).where(F.col("_n") == len(lists)).select(id_col)


def union(lists: list[DataFrame], id_col: str = "doc_id") -> DataFrame:
    """The ids that any list has, once each."""
    return reduce(DataFrame.unionByName, [d.select(id_col) for d in lists]).distinct()
