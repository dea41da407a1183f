"""Connected components of a graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.durable import delete, durable, shared_folder
from tessera.plans.skew import grouped


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: neighbours are tied to the smallest node in reach.

    The smallest neighbour comes from a partial aggregation and is joined back to the edges, so the
    neighbours of a hub are never gathered in one place.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = grouped(both, ["u"], F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = both.join(least, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = out.where("u != v")
    return out if large else out.distinct()  # edges that repeat in between do no harm


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (columns ``u`` and ``v``, of one ordered type).

    The root is the smallest node of the component. Edges may repeat and stand either way round;
    edges with a null end are ignored. Alternating large and small stars end after a number of
    rounds that is logarithmic in the components' size. Each round is a table in the shared folder,
    so that the next is planned from its files' sizes: estimates carried through the joins of all
    rounds would grow exponentially. The table of the round before is deleted.
    """
    spark = edges.sparkSession
    folder = shared_folder(spark, "components")

    def stored(df: DataFrame, k: int) -> DataFrame:
        df.write.parquet(f"{folder}/{k}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{k}")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    try:
        edges = edges.where("u is not null and v is not null and u != v")
        now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), 0)
        before = state(now)
        for k in range(1, rounds + 1):
            now = stored(_star(_star(now, large=True), large=False), k)
            delete(spark, f"{folder}/{k - 1}")
            after = state(now)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        now = durable(now)
    finally:
        delete(spark, folder)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
