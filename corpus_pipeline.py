"""A training corpus from ``documents``: four filters and a tokenizer, each a DataFrame to a DataFrame.

Every stage works on all rows that its predecessor kept and returns the columns of ``documents``;
the last returns token ids. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe_codec, decontamination, exact_dedup, near_dedup, quality
from tessera.plans.durable import delete, durable, shared_folder
from tessera.sources.tables import table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from ``labels``, doesn't reject."""
    return quality.only_good(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with texts equal but for white space."""
    return exact_dedup.without_copies(docs)


def unlike_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingle sets with a similarity of 0.8 or more."""
    return near_dedup.one_of_each(docs)


def uncontaminated_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of ``benchmark`` occurs."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, the token ``ids`` and the SHA-256 of the text that they decode to."""
    return bpe_codec.bpe_codec(docs).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded"), 256).alias("decoded_sha256")
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_documents),
    ("exact dedup", distinct_documents),
    ("near dedup", unlike_documents),
    ("decontamination", uncontaminated_documents),
    ("bpe encoding", token_ids),
]

#: SQL expresses neither the classifier nor edit matching; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``.

    What a stage leaves is kept in the shared folder until the next has been written; the last
    stage's rows are a checkpoint. Nothing else stays, nor after a failure.
    """
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark, "corpus")
    try:
        for k, (_, stage) in enumerate(STAGES[:-1]):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                delete(spark, f"{folder}/{k - 1}")
        return durable(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        delete(spark, folder)
