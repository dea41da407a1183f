"""Documents as bags of weighted words, over a corpus-wide vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.plans.skew import grouped

#: Words in a vocabulary, at most; it is sent to the tasks.
MOST_WORDS = 1_000_000


def term_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens=T.words) -> DataFrame:
    """``id_col``, ``word`` and ``n``."""
    return docs.select(id_col, F.explode(tokens(F.col(text_col))).alias("word")).groupBy(id_col, "word").agg(F.count("*").alias("n"))


def tfidf(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``word`` and ``weight``: n / length * ln(documents / documents with the word).

    Documents without words count among the documents.
    """
    # The array behind a generator is made once: its length and its words come from the same one.
    listed = docs.select(id_col, F.explode(F.array(T.words(F.col(text_col)))).alias("_words"))
    words = listed.select(id_col, F.size("_words").alias("_len"), F.explode("_words").alias("word"))
    counts = words.groupBy(id_col, "_len", "word").agg(F.count("*").alias("n"))
    # Reads ``n``, so that both branches need the same aggregate and it is made once.
    frequency = grouped(counts, ["word"], F.sum((F.col("n") > 0).cast("int")).alias("_df"))
    n_docs = F.lit(docs.count())
    both = counts.join(frequency, "word")
    return both.select(id_col, "word", (F.col("n") / F.col("_len") * F.ln(n_docs / F.col("_df"))).alias("weight"))


def vocabulary(docs: DataFrame, size: int, text_col: str = "text") -> DataFrame:
    """``slot`` (from 0), ``word`` and ``n``: the most frequent words, ties by word."""
    if not 0 < size <= MOST_WORDS:
        raise ValueError(f"a vocabulary has 1 to {MOST_WORDS} words")
    counts = docs.select(F.explode(T.words(F.col(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(size)
    return top.withColumn("slot", (F.row_number().over(Window.orderBy(F.desc("n"), "word")) - 1).cast("long")).select("slot", "word", "n")


def bag_of_words(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``slot`` and ``n`` for the words of the vocabulary."""
    slots = F.broadcast(vocabulary(docs, size, text_col).select("slot", "word"))
    return term_counts(docs, id_col, text_col).join(slots, "word").select(id_col, "slot", "n")


def mean_embedding(docs: DataFrame, embeddings: DataFrame, id_col: str = "doc_id", text_col: str = "text", weight: Column | None = None) -> DataFrame:
    """``id_col`` and ``vec``: the mean of the vectors of a document's known words, by how often they occur.

    ``weight`` (a column over ``n``) counts instead of ``n``. Documents without a known word have no row.
    """
    w = (F.col("n") if weight is None else weight).cast("double")
    known = term_counts(docs, id_col, text_col).join(embeddings.select("word", "vec"), "word")
    parts = known.select(id_col, w.alias("_w"), F.posexplode("vec").alias("_at", "_x")).groupBy(id_col, "_at")
    means = parts.agg((F.sum(F.col("_x") * F.col("_w")) / F.sum("_w")).alias("_x"))
    ordered = F.array_sort(F.collect_list(F.struct("_at", "_x")))
    return means.groupBy(id_col).agg(F.transform(ordered, lambda s: s["_x"]).alias("vec"))
