"""A log of writes in transactions, and the state that replaying it gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``lsn`` orders entries; ``op`` is put, delete, prepare, commit or abort; the last three have no key.
SCHEMA = "lsn long, tx long, op string, key string, value string"


def append(entries: DataFrame, path: str) -> None:
    """Add entries as files of their own: readers see all of them or none."""
    entries.select("lsn", "tx", "op", "key", "value").write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def replayed(entries: DataFrame) -> DataFrame:
    """``key``, ``value`` and ``lsn`` of what stands: the last put of each key that no delete follows.

    Only entries of transactions that were committed, and not aborted after that, count.
    """
    ends = entries.where(F.col("op").isin("commit", "abort")).groupBy("tx").agg(F.max_by("op", "lsn").alias("end"))
    done = entries.where(F.col("op").isin("put", "delete")).join(ends.where("end = 'commit'"), "tx", "left_semi")
    last = done.groupBy("key").agg(F.max_by(F.struct("op", "value", "lsn"), "lsn").alias("l"))
    return last.where("l.op = 'put'").select("key", "l.value", "l.lsn")


def compacted(entries: DataFrame) -> DataFrame:
    """Entries that replaying still needs: the last write of each key and transactions' ends."""
    state = replayed(entries).select("lsn")
    return entries.join(state, "lsn", "left_semi").unionByName(entries.where(F.col("op").isin("commit", "abort")))
