"""Exact deduplication by progressive refinement, in DataFrame operations only.

Rows are grouped by the length of their normalised text, then by a hash of its prefix, then by a
hash of the whole of it. Only rows that still share a group with another row go on to the next,
dearer key. Groups are counted with partial aggregation, so a group with a third of all rows costs
one row per task in the shuffle; joins back to rows are plain equi-joins that adaptive execution
may split.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.rows import fresh
from tessera.plans.durable import durable
from tessera.plans.skew import grouped
from tessera.sources.tables import table

#: Lengths are counted modulo this; so many rows at most are broadcast.
LENGTH_BINS = 65_536
#: Characters of the normalised text that the second key sees.
PREFIX = 256


def squeezed(text: Column) -> Column:
    """``text`` without white space (space, and 0x09 to 0x0D); null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]", "")


def full_hash(norm: Column) -> Column:
    return F.sha2(norm, 256)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = squeezed,
    with_digest: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_hash``.

    Texts are equal when ``normalise`` makes them identical; a null text counts as empty. Of equal
    texts, the row with the most code points in the original text stays, then the one with the
    smallest id (null ids last); of rows alike in both, exactly one. Null ids are ids like others.
    Other columns of ``docs`` are ignored whatever their names. An empty table gives no rows.

    ``with_digest``: the caller needs the full hash of every text anyway, so it is taken in the
    first pass and given as ``text_hash``. Without it, only rows whose length and prefix hash occur
    again are read once more and hashed whole; ``text_hash`` is null for the others.
    """
    norm = normalise(F.col(text_col))
    cheap = [
        F.col(id_col).alias("_id"),
        F.length(norm).alias("_len"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("_chars"),
        F.xxhash64(F.substring(norm, 1, PREFIX)).alias("_prefix"),
    ]
    digest = full_hash(norm).alias("_full")
    row = F.monotonically_increasing_id().alias("_row")
    # Narrow rows, stored once: later steps and their row numbers stay the same whatever is lost.
    first = durable(docs.select(*cheap, *([digest] if with_digest else []), row))

    bin_ = F.pmod(F.col("_len"), F.lit(LENGTH_BINS)).alias("_bin")
    lengths = first.groupBy(bin_).count().where("count > 1").select("_bin")
    same_length = first.withColumn("_bin", bin_).join(F.broadcast(lengths), "_bin", "left_semi").drop("_bin")
    prefixes = grouped(same_length, ["_len", "_prefix"], F.count("*").alias("_n")).where("_n > 1").drop("_n")
    same_prefix = same_length.join(prefixes, ["_len", "_prefix"], "left_semi")

    if with_digest:
        rows, alone = first, None
        candidates = same_prefix
    else:
        again = durable(same_prefix.select("_id").distinct())
        whole = docs.select(*cheap, F.col(text_col).alias("_text"))
        is_again = whole["_id"].eqNullSafe(again["_id"])
        rows = whole.join(again, is_again, "left_semi").select(
            "_id", "_len", "_chars", "_prefix", full_hash(normalise(F.col("_text"))).alias("_full"), row
        )
        rows = candidates = durable(rows)
        alone = first.join(again, first["_id"].eqNullSafe(again["_id"]), "left_anti")

    best = F.min(F.struct((-F.col("_chars")).alias("c"), F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_row").alias("r")))
    groups = grouped(candidates, ["_len", "_prefix", "_full"], F.count("*").alias("_n"), best.alias("_best")).where("_n > 1")
    out = rows.join(groups, ["_len", "_prefix", "_full"], "left").select(
        F.col("_id").alias(id_col),
        F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_best.i")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_best.r") == F.col("_row"), F.lit(True)).alias("kept"),
        F.col("_full").alias("text_hash"),
    )
    if alone is None:
        return out
    return out.unionByName(
        alone.select(
            F.col("_id").alias(id_col),
            F.col("_id").alias("keep_id"),
            F.lit(1).cast("long").alias("group_size"),
            F.lit(True).alias("kept"),
            F.lit(None).cast("string").alias("text_hash"),
        )
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the one row of each group of equal texts that ``exact_dedup`` keeps, all columns.

    Of rows with the same id and equal texts, one stays (most code points, then the smaller text).
    """
    dropped = exact_dedup(docs, id_col, text_col).where(~F.col("kept")).select(
        F.col(id_col).alias("_drop_id"), F.col("text_hash").alias("_drop_hash"), (F.col("keep_id").eqNullSafe(F.col(id_col))).alias("_twin")
    ).distinct()
    # A row goes when its id and text are among those dropped; of repeated rows with the keeper's own id one is put back.
    plain = durable(dropped)
    h, k = fresh(docs, "_hash"), fresh(docs, "_place")
    hashed = docs.withColumn(h, full_hash(squeezed(F.col(text_col))))
    on = hashed[id_col].eqNullSafe(plain["_drop_id"]) & (hashed[h] == plain["_drop_hash"])
    left = hashed.join(plain, on, "left_anti").drop(h)
    twins = plain.where("_twin")
    if twins.isEmpty():
        return left
    on = hashed[id_col].eqNullSafe(twins["_drop_id"]) & (hashed[h] == twins["_drop_hash"])
    w = Window.partitionBy(id_col, h).orderBy(F.length(text_col).desc_nulls_last(), F.col(text_col).asc_nulls_last())
    back = hashed.join(twins, on, "left_semi").withColumn(k, F.row_number().over(w)).where(F.col(k) == 1).drop(k, h)
    return left.unionByName(back)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), with_digest=True).withColumnRenamed("text_hash", "text_sha256")


QUERIES = {"op10_exact_dedup": op10_exact_dedup}

ORACLE_SQL = {
    "op10_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
}
