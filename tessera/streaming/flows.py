"""Streams of records: windows, deduplication, and imports that follow a growing source."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import ivf
from tessera.plans.durable import shared_folder
from tessera.sources.store import Store


def tumbling(rows: DataFrame, time: str, window: str, by: Sequence[str], *aggregates: Column, late: str = "10 minutes") -> DataFrame:
    """Aggregates by window and key; rows later than ``late`` are dropped in a stream."""
    rows = rows.withColumn(time, F.col(time).cast("timestamp"))
    return rows.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(*aggregates)


def distinct_within(rows: DataFrame, time: str, keys: Sequence[str], late: str = "10 minutes") -> DataFrame:
    """One row per key within the watermark."""
    rows = rows.withColumn(time, F.col(time).cast("timestamp"))
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def import_into(store: Store, name: str, key: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch's rows replace those with the same key in a table of ``store``."""

    def put(batch: DataFrame, _: int) -> None:
        rows = transform(batch) if transform else batch
        rows = rows.dropDuplicates([key])
        if name in store.tables():
            store.upsert(name, rows, key)
        else:
            store.create(name, rows)

    return put


def update_centroids(vectors: DataFrame, cids: Sequence, centroids, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """``cid`` and ``c``: the means of the vectors that are nearest to each centroid now."""
    return ivf.means(ivf.assigned(vectors, cids, centroids, id_col, vec), "cid", vec)


def replay(spark: SparkSession, path: str, schema, transform: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """All rows that a stream over the Parquet files of a folder gives, run to its end into a table in the shared folder.

    In the mode ``complete`` each batch is the whole result and replaces the one before.
    """
    folder = shared_folder(spark, "replay")
    rows = transform(spark.readStream.schema(schema).parquet(path))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{'all' if mode == 'complete' else number}")

    query = rows.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).option("recursiveFileLookup", True).parquet(folder)
