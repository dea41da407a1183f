"""Stupid-backoff language-model scores of documents, from n-gram counts over all the others.

Every run of 1 to n words is a 64-bit key. Documents are dealt into buckets; a bucket sends its
distinct n-grams with their counts to the count tables, which are partitioned by hash, and each
partition sends the totals of those keys back: the join of n-gram tables with exploded n-grams, with
the n-grams of a bucket pre-aggregated and in sorted runs. A document is no evidence for itself: its
own occurrences are taken off the totals. With c(x) for what is left, a document's score is the sum
over its words of the logarithm of

    c(context + word) / c(context)               if c(context + word) > 0
    0.4 * the score with the context shortened   otherwise
    c(word) / N                                  without context
    0.4 / (N + 1)                                for a word that no other document has

where N is the number of words of the other documents. An n-gram of three words or more occurs
elsewhere only if the two shorter ones within it do, so only those are sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import batches, exchange, words
from tessera.sources.tables import table

#: Words in the longest n-grams, and the factor of a backoff.
ORDER, BACKOFF = 3, 0.4


def _own(owner: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How often each n-gram occurs in the text that it stands in."""
    order = np.lexsort((place, owner))
    new = np.r_[True, (place[order][1:] != place[order][:-1]) | (owner[order][1:] != owner[order][:-1])][: len(order)]
    run = np.cumsum(new) - 1
    out = np.empty(len(order), np.int64)
    out[order] = np.bincount(run, minlength=1)[run] if len(order) else 0
    return out


class Bucket:
    """The words of a bucket's texts, and what the count tables have replied about their n-grams."""

    def __init__(self, table: pa.Table, replies: pa.Table | None, parts: int):
        self.rows = exchange.rows_of(table)
        self.words = words.split(exchange.column(self.rows, "_text"))
        self.number, self.owner, self.parts, self.replies = words.numbers(self.words), self.words.owner(), parts, replies
        self.elsewhere: dict[int, np.ndarray] = {}  # by n: for each word, how often other texts have the n-gram that starts there

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams that the count tables are asked about, and the word at which each starts."""
        gram, at = words.grams(self.number, self.words, n)
        if n > 2:
            shorter = self.counts(n - 1)
            asked = (shorter[at] > 0) & (shorter[at + 1] > 0)
            gram, at = gram[asked], at[asked]
        return gram, at

    def counts(self, n: int) -> np.ndarray:
        if n not in self.elsewhere:
            gram, at = self.grams(n)
            keys, place = np.unique(gram, return_inverse=True)
            totals = exchange.totals_of(self.replies, n, np.int64, exchange.from_numbers, keys, self.parts)
            out = np.zeros(len(self.number), np.int64)
            out[at] = totals[place] - _own(self.owner[at], place)
            self.elsewhere[n] = out
        return self.elsewhere[n]

    def requests(self, bucket: int, n: int) -> list[tuple]:
        keys, counts = np.unique(self.grams(n)[0], return_counts=True)
        return list(exchange.request(bucket, n, keys, counts, self.parts))

    def word_scores(self, order: int, all_words: int, backoff: float) -> np.ndarray:
        """The log score of each word."""
        others = (all_words - self.words.counts())[self.owner]
        one = self.counts(1)
        score = np.log(backoff) - np.log(others + 1)
        score[one > 0] = np.log(one[one > 0] / others[one > 0])
        place = self.words.place()
        for n in range(2, order + 1):
            last = np.flatnonzero(place >= n - 1)  # words that an n-gram ends with
            whole, context = self.counts(n)[last - n + 1], self.counts(n - 1)[last - n + 1]
            seen = whole > 0
            new = score[last] + np.log(backoff)
            new[seen] = np.log(whole[seen] / context[seen])
            score[last] = new
        return score


def _word_total(docs: DataFrame) -> int:
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches.pieces(parts, "_text"):
            yield pa.RecordBatch.from_arrays([pa.array([len(words.split(part.column("_text")).starts)], pa.int64())], ["n"])

    return docs.mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0


def scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    backoff: float = BACKOFF,
    bucket_bytes: int = exchange.BUCKET_BYTES,
) -> DataFrame:
    """``id_col``, ``n_words`` and ``log_score`` (sum over the words): one row per row of ``docs``.

    Counts are taken over all rows of ``docs`` but the one that is scored; repeated rows are evidence
    for each other. A null text counts as empty; a text without words scores 0. Null ids stay as they
    are; other columns are ignored whatever their names. N-grams with equal numbers in one partition
    are taken as equal.
    """
    if order < 1 or not 0 < backoff <= 1:
        raise ValueError("order must be 1 or more, backoff above 0 and 1 at most")
    rows, parts, kind = exchange.bucketed(docs, id_col, text_col, bucket_bytes)
    all_words = _word_total(docs.select(F.col(text_col).cast("string").alias("_text")))

    def ask_first(table: pa.Table) -> pa.Table:
        b, bucket = Bucket(table, None, parts), table.column("bucket")[0].as_py()
        return exchange.requests_table([r for n in range(1, min(order, 2) + 1) for r in b.requests(bucket, n)])

    def ask(n: int):
        def of(table: pa.Table, replies: pa.Table) -> pa.Table:
            if not table.num_rows:
                return exchange.requests_table([])
            return exchange.requests_table(Bucket(table, replies, parts).requests(table.column("bucket")[0].as_py(), n))

        return of

    def score(table: pa.Table, replies: pa.Table) -> pa.Table:
        b = Bucket(table, replies, parts)
        each = b.word_scores(order, all_words, backoff)
        total = np.bincount(b.owner, weights=each, minlength=b.rows.num_rows)
        return pa.table([exchange.column(b.rows, "_id"), pa.array(b.words.counts(), pa.int64()), pa.array(total, pa.float64())], names=["_id", "n_words", "log_score"])

    by_bucket = rows.groupBy("bucket")
    counted = exchange.answer(by_bucket.applyInArrow(ask_first, exchange.REQUEST), exchange.numbers)
    for n in range(3, order + 1):
        asked = by_bucket.cogroup(counted.groupBy("bucket")).applyInArrow(ask(n), exchange.REQUEST)
        counted = counted.unionByName(exchange.answer(asked, exchange.numbers))
    schema = f"_id {kind}, n_words long, log_score double"
    return by_bucket.cogroup(counted.groupBy("bucket")).applyInArrow(score, schema).withColumnRenamed("_id", id_col)


def ngram_counts(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = exchange.BUCKET_BYTES) -> DataFrame:
    """``gram`` (the 64-bit number of a run of ``n`` words) and ``count`` over all rows of ``docs``, in hash partitions."""
    rows, parts, _ = exchange.bucketed(docs, id_col, text_col, bucket_bytes)

    def ask(table: pa.Table) -> pa.Table:
        w = words.split(exchange.column(exchange.rows_of(table), "_text"))
        keys, counts = np.unique(words.grams(words.numbers(w), w, n)[0], return_counts=True)
        return exchange.requests_table(list(exchange.request(table.column("bucket")[0].as_py(), n, keys, counts, parts)))

    def add(table: pa.Table) -> pa.Table:
        keys, totals = exchange.summed(table)
        return pa.table([pa.array(keys.view(np.int64)), pa.array(totals)], names=["gram", "count"])

    return rows.groupBy("bucket").applyInArrow(ask, exchange.REQUEST).groupBy("part").applyInArrow(add, "gram long, count long")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram scores of all documents, with the score for each word, rounded to 6 decimals."""
    each = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(F.lit(0.0))
    return scores(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round(each, 6).alias("mean_log_score")
    )


QUERIES = {"op2_lm_scoring": op2_lm_scoring}

ORACLE_SQL = {
    "op2_lm_scoring": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM d),
p AS (SELECT doc_id, word, lag(word) OVER o AS b1, lag(word, 2) OVER o AS b2 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g1 AS (SELECT doc_id, word, count(*) AS own FROM w GROUP BY doc_id, word),
e1 AS (SELECT doc_id, word, sum(own) OVER (PARTITION BY word) - own AS c FROM g1),
g2 AS (SELECT doc_id, b1, word, count(*) AS own FROM p WHERE b1 IS NOT NULL GROUP BY doc_id, b1, word),
e2 AS (SELECT doc_id, b1, word, sum(own) OVER (PARTITION BY b1, word) - own AS c FROM g2),
g3 AS (SELECT doc_id, b2, b1, word, count(*) AS own FROM p WHERE b2 IS NOT NULL GROUP BY doc_id, b2, b1, word),
e3 AS (SELECT doc_id, b2, b1, word, sum(own) OVER (PARTITION BY b2, b1, word) - own AS c FROM g3),
n AS (SELECT doc_id, sum(len(ws)) OVER () - len(ws) AS others FROM d),
s AS (
  SELECT p.doc_id, CASE
    WHEN x3.c > 0 THEN ln(x3.c / y2.c)
    WHEN x2.c > 0 THEN ln(x2.c / y1.c) + CASE WHEN p.b2 IS NULL THEN 0 ELSE ln(0.4) END
    ELSE CASE WHEN x1.c > 0 THEN ln(x1.c / n.others) ELSE ln(0.4) - ln(n.others + 1) END
         + CASE WHEN p.b1 IS NULL THEN 0 ELSE ln(0.4) END + CASE WHEN p.b2 IS NULL THEN 0 ELSE ln(0.4) END END AS score
  FROM p JOIN n ON n.doc_id = p.doc_id JOIN e1 x1 ON x1.doc_id = p.doc_id AND x1.word = p.word
  LEFT JOIN e1 y1 ON y1.doc_id = p.doc_id AND y1.word = p.b1
  LEFT JOIN e2 x2 ON x2.doc_id = p.doc_id AND x2.b1 = p.b1 AND x2.word = p.word
  LEFT JOIN e2 y2 ON y2.doc_id = p.doc_id AND y2.b1 = p.b2 AND y2.word = p.b1
  LEFT JOIN e3 x3 ON x3.doc_id = p.doc_id AND x3.b2 = p.b2 AND x3.b1 = p.b1 AND x3.word = p.word),
t AS (SELECT doc_id, count(*) AS n_words, sum(score) AS log_score FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, round(coalesce(log_score, 0.0), 4) AS log_score,
       round(coalesce(log_score / n_words, 0.0), 6) AS mean_log_score
FROM d LEFT JOIN t ON t.doc_id = d.doc_id
"""
}
