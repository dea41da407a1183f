"""Places of rows in an order, whole table or by group, without one task that sorts a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.durable import durable


def ranked(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], place: str = "_place", total: str | None = None) -> DataFrame:
    """``rows`` with ``place``: gapless from 1 within each group in the given order; ``total``: rows of the group.

    Rows are range-partitioned by group and order, and stored, since counting and numbering must see
    the same partitions. A partition's rows are numbered on their own and start behind those of the
    partitions before it; only counts by partition and group meet in one place.
    """
    part, k, start = "_ranked_part", "_ranked_k", "_ranked_start"
    spread = durable(rows.repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id()))
    held = spread.groupBy(part, *by).agg(F.count("*").alias("_held"))
    # As many rows as partitions and groups, and each group's counts in its own window.
    before = Window.partitionBy(*by).orderBy(part)
    starts = held.select(
        part,
        *by,
        F.coalesce(F.sum("_held").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(start),
        *([F.sum("_held").over(Window.partitionBy(*by)).alias(total)] if total else []),
    )
    within = F.row_number().over(Window.partitionBy(part, *by).orderBy(*order))
    numbered = spread.withColumn(k, within)
    on = numbered[part] == starts[part]
    for c in by:
        on = on & numbered[c].eqNullSafe(starts[c])
    out = numbered.join(starts, on).withColumn(place, (F.col(start) + F.col(k)).cast("long"))
    return out.select(*[numbered[c] for c in rows.columns], place, *([total] if total else []))
