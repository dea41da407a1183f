"""Aggregations whose result is joined back to the rows that they were made from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grouped(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """``df.groupBy(*keys).agg(*aggregates)``, partitioned by a struct of the keys.

    Partial aggregation leaves one row per key and task to shuffle. Partitioned by the keys
    themselves, the result would be joined where it lies, and then adaptive execution can't split a
    key with very many rows on the other side. So a join on the keys shuffles both sides anew, the
    aggregated one being small.
    """
    return df.groupBy(F.struct(*keys).alias("_group")).agg(*aggregates).select("_group.*", "*").drop("_group")
