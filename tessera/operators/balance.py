"""Dealing requests out to nodes, as projections over the requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.versions import point
from tessera.plans.ranks import ranked


def in_turn(requests: DataFrame, order: Sequence[str], weights: Sequence[int], out: str = "node") -> DataFrame:
    """Requests in their order, to node 0 ``weights[0]`` times, then node 1, and so on in rounds."""
    if not weights or min(weights) < 0 or not sum(weights):
        raise ValueError("weights must be 0 or more and have a sum above 0")
    turns = F.array(*[F.lit(i) for i, w in enumerate(weights) for _ in range(w)])
    placed = ranked(requests, [], order, "_turn")
    return placed.withColumn(out, F.get(turns, F.pmod(F.col("_turn") - 1, F.lit(sum(weights))).cast("int"))).drop("_turn")


def by_key(key: Column, nodes: int) -> Column:
    """The same node for the same key."""
    return F.pmod(point(key), F.lit(nodes)).cast("int")


def least_loaded(nodes: DataFrame, load: str, node: str = "node") -> DataFrame:
    """The node with the smallest load, ties by its name."""
    return nodes.orderBy(load, node).limit(1)
