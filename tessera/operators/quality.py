"""Retrieval quality: ranked results against relevant ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics(results: DataFrame, truth: DataFrame, by: str = "query_id", id_col: str = "id") -> DataFrame:
    """``by``, ``recall``, ``precision``, ``f1``, ``ndcg``, ``mrr`` for every query of either table.

    ``results`` have a ``rank`` from 1. Gains are binary; a metric whose denominator is 0 is 0.
    """
    known = truth.select(by, id_col).distinct().withColumn("_true", F.lit(1))
    gain = F.sum(F.when(F.col("_true") == 1, 1 / F.log2(F.col("rank") + 1)))
    got = results.join(known, [by, id_col], "left").groupBy(by).agg(
        F.count("*").alias("_n"),
        F.coalesce(F.sum("_true"), F.lit(0)).alias("_hits"),
        F.coalesce(gain, F.lit(0.0)).alias("_dcg"),
        F.min(F.when(F.col("_true") == 1, F.col("rank"))).alias("_first"),
    )
    every = known.groupBy(by).agg(F.count("*").alias("_t")).join(got, by, "full_outer").na.fill(0, ["_t", "_n", "_hits", "_dcg"])
    ideal = F.aggregate(
        F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("_n", "_t")).cast("int")), lambda i: 1 / F.log2(i + 1)),
        F.lit(0.0),
        lambda s, x: s + x,
    )
    ratio = lambda a, b: F.when(b > 0, a / F.nullif(b, F.lit(0))).otherwise(F.lit(0.0))
    out = every.withColumn("recall", ratio(F.col("_hits"), F.col("_t"))).withColumn("precision", ratio(F.col("_hits"), F.col("_n")))
    both = F.col("recall") + F.col("precision")
    return out.select(
        by,
        "recall",
        "precision",
        F.when(both > 0, 2 * F.col("recall") * F.col("precision") / F.nullif(both, F.lit(0.0))).otherwise(0.0).alias("f1"),
        F.when(F.least("_n", "_t") > 0, F.col("_dcg") / ideal).otherwise(0.0).alias("ndcg"),
        F.when(F.col("_first").isNotNull(), 1 / F.col("_first")).otherwise(0.0).alias("mrr"),
    )


def estimate(results: DataFrame, k: int, by: str = "query_id", timed: bool = False) -> DataFrame:
    """``by`` and ``quality``: 0.4 for their number, 0.5 for how even the similarities are, 0.1 for time."""
    n = F.count("*")
    even = 1 / (1 + F.var_pop("similarity"))
    top = F.max("similarity")
    even = F.when(top < 0.5, even * top * 2).otherwise(even)
    value = 0.4 * F.least(F.lit(1.0), n / F.lit(float(k))) + 0.5 * even + F.lit(0.1 * (0.8 if timed else 1.0))
    return results.groupBy(by).agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)).alias("quality"))


def above(results: DataFrame, quality: float) -> DataFrame:
    """Results with a similarity of at least half the quality that is asked for."""
    return results.where(F.col("similarity") >= quality * 0.5)


def effectiveness(recall, precision, milliseconds):
    """0.4 recall + 0.4 precision + 0.2 for how far the time is below 100 ms."""
    return 0.4 * recall + 0.4 * precision + 0.2 * F.greatest(F.lit(0.0), 1 - milliseconds / 100.0)


def tuned(history: DataFrame, settings: str = "settings") -> DataFrame:
    """The settings with the best mean effectiveness over ``recall``, ``precision`` and ``ms``, ties by the settings."""
    value = effectiveness(F.col("recall"), F.col("precision"), F.col("ms"))
    return history.groupBy(settings).agg(F.avg(value).alias("effectiveness")).orderBy(F.desc("effectiveness"), settings).limit(1)
