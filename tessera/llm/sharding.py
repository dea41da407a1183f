"""Weighted rendezvous hashing of record keys to shards, with gapless slots in each shard.

Every row scores each shard by ``-ln(u) / weight``, where ``u`` is a uniform number made from a
hash of the key and the shard's number; the smallest score wins. A score depends on nothing else,
so one more shard only takes rows for itself and moves none between the others.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.durable import durable
from tessera.sources.tables import table

#: Each shard is dealt out over so many bins for numbering its rows.
SLOT_BINS = 1024


def _score(key: Column, shard: int, weight: float) -> Column:
    """A struct that orders by score, then shard."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    return F.struct((-F.ln(u) / F.lit(float(weight))).alias("score"), F.lit(shard).alias("shard"))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 to ``len(weights) - 1``) that ``key`` goes to; a shard of weight 0 gets nothing.

    A null key is a key of its own. Rows of one key share a shard.
    """
    if any(not 0 <= w < math.inf for w in weights):
        raise ValueError("weights must be numbers of 0 or more")
    scores = [_score(key, i, w) for i, w in enumerate(weights) if w > 0]
    if not scores:
        raise ValueError("at least one shard needs a weight above 0")
    return (F.least(*scores) if len(scores) > 1 else scores[0])["shard"]


def shard(
    df: DataFrame,
    key_col: str,
    weights: Sequence[float],
    tie_cols: Sequence[str] = (),
    shard_col: str = "shard",
    slot_col: str = "slot",
) -> DataFrame:
    """``df`` with ``shard_col`` (int) and ``slot_col`` (long, gapless from 0 within each shard).

    Rows of a shard are dealt over ``SLOT_BINS`` bins by a hash of key and ``tie_cols``; a bin's rows
    are numbered on their own and start after the rows of the bins before it. What is broadcast are
    the counts of bins: ``len(weights) * SLOT_BINS`` rows at most. Rows alike in key and ties are
    numbered in any order. A null key is a key; an empty table gives no rows. Columns of ``df`` that
    are named as the two new ones give way to them. ``df`` should be
    narrow: it is stored once, as both the counts and the numbering read it.
    """
    bins = F.pmod(F.xxhash64(F.col(key_col), *map(F.col, tie_cols), F.lit(-1)), F.lit(SLOT_BINS)).cast("int")
    # Inner names cannot clash: the caller's columns travel inside a struct.
    rows = durable(
        df.select(
            F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_r"),
            rendezvous(F.col(key_col), weights).alias("_shard"),
            bins.alias("_bin"),
        )
    )
    before = Window.partitionBy("_shard").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("_shard", "_bin").count().withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    )
    new = {shard_col.lower(), slot_col.lower()}
    kept = [F.col(f"_r.`{c}`") for c in df.columns if c.lower() not in new]
    within = Window.partitionBy("_shard", "_bin").orderBy(F.col(f"_r.`{key_col}`"), *[F.col(f"_r.`{c}`") for c in tie_cols])
    return (
        rows.withColumn("_k", F.row_number().over(within))
        .join(F.broadcast(starts), ["_shard", "_bin"])
        .select(*kept, F.col("_shard").alias(shard_col), (F.col("_start") + F.col("_k") - 1).cast("long").alias(slot_col))
    )


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 24 equal shards, with the shard each would have among 25."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col("doc_id"), [1.0] * 25).cast("int").alias("grown_shard"),
    )
    return shard(narrow, "doc_id", [1.0] * 24, tie_cols=("text_crc32", "size"))


QUERIES = {"op1_shards": op1_shards}
