"""Exact neighbours in cells of vectors through trees that halve space, component by component.

A tree prunes where the splitting plane is further away than the k-th neighbour found; so results
are those of a full scan. Trees are built by the task that searches a cell's shard; shards have
``MOST_POINTS`` vectors at most.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import knn

#: Vectors in one tree, about, and in a leaf, at most.
MOST_POINTS, LEAF = 100_000, 32


class Tree:
    """Points halved at the median of the component that spreads widest, down to leaves."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.root = self._split(np.arange(len(ids)))

    def _split(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        some = self.x[rows]
        axis = int((some.max(axis=0) - some.min(axis=0)).argmax())
        order = rows[np.argsort(some[:, axis], kind="stable")]
        middle = len(order) // 2
        return axis, float(self.x[order[middle], axis]), self._split(order[:middle]), self._split(order[middle:])

    def nearest(self, q: np.ndarray, k: int) -> list[tuple[float, int]]:
        """(squared distance to nine decimals, id) of the ``k`` nearest, ties by id."""
        found: list[tuple[float, int]] = []  # a heap of (-distance, -id)

        def visit(node) -> None:
            if isinstance(node, np.ndarray):
                d = np.round(((self.x[node] - q) ** 2).sum(axis=1), 9)
                for e, i in zip(d.tolist(), self.ids[node].tolist(), strict=True):
                    if len(found) < k:
                        heapq.heappush(found, (-e, -i))
                    elif (-e, -i) > found[0]:
                        heapq.heapreplace(found, (-e, -i))
                return
            axis, at, low, high = node
            gap = q[axis] - at
            visit(low if gap < 0 else high)
            if len(found) < k or gap * gap <= -found[0][0] + 1e-9:
                visit(high if gap < 0 else low)

        visit(self.root)
        return sorted((-d, -i) for d, i in found)


def batch(
    vectors: DataFrame, queries: Sequence[tuple[int, Sequence[float]]], k: int, id_col: str = "id", vec: str = "vec", cell: str | None = None, visit: Sequence[Sequence] | None = None
) -> DataFrame:
    """``query_id``, ``rank``, ``id_col``, ``distance`` (Euclidean): the exact ``k`` nearest to each query, ties by id.

    ``visit``: for each query the cells that it goes to (all, if None). Ids are numbers; null vectors
    don't count. Queries are taken 1,024 at a time.
    """
    if k <= 0:
        raise ValueError("k must be above 0")
    rows = vectors.where(F.col(vec).isNotNull()).select(
        F.col(id_col).cast("long").alias("_id"), F.col(vec).cast("array<double>").alias("_vec"), (F.lit(0) if cell is None else F.col(cell)).alias("cell")
    )
    shards = max(1, math.ceil((rows.groupBy("cell").count().agg(F.max("count")).first()[0] or 0) / MOST_POINTS))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("_id"), F.lit(shards)).cast("int"))

    def of_block(some: Sequence, cells: Sequence[set] | None) -> DataFrame:
        def look(key: tuple, table: pa.Table) -> pa.Table:
            x = table.column("_vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
            tree = Tree(table.column("_id").to_numpy(), x)
            found = [
                (name, n, math.sqrt(d))
                for i, (name, q) in enumerate(some)
                if cells is None or key[0].as_py() in cells[i]
                for d, n in tree.nearest(np.array(q, float), k)
            ]
            name, n, d = zip(*found, strict=True) if found else ((), (), ())
            return pa.table([pa.array(name, pa.int64()), pa.array(n, pa.int64()), pa.array(d, pa.float64())], names=["query_id", "_id", "distance"])

        return rows.groupBy("cell", "shard").applyInArrow(look, "query_id long, _id long, distance double")

    out = knn.by_block(of_block, queries, visit)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 9), "_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("_id").alias(id_col), "distance")
