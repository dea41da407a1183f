"""k-means with Spark's own implementation, and a deterministic Lloyd iteration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import ivf


def fit(vectors: DataFrame, k: int, iterations: int = 20, tolerance: float = 1e-4, seed: int = 42, vec: str = "vec") -> np.ndarray:
    """Centroids by k-means|| on the whole table."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if vectors.limit(k).count() < k:
        raise ValueError(f"fewer than {k} vectors")
    data = vectors.select(array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    model = KMeans(k=k, maxIter=iterations, tol=tolerance, seed=seed).fit(data)
    return np.array(model.clusterCenters())


def lloyd(vectors: DataFrame, k: int, rounds: int, id_col: str = "id", vec: str = "vec", empty_as_zero: bool = True) -> DataFrame:
    """``cid`` and ``c`` after ``rounds`` rounds, begun with the vectors of the ``k`` smallest ids.

    A centroid without vectors becomes zeros (or stays, if not ``empty_as_zero``). Each round is one
    aggregation; ``k`` centroids come to the driver between rounds.
    """
    first = vectors.select(id_col, F.col(vec).cast("array<double>").alias("v")).orderBy(id_col).limit(k).collect()
    centroids, cids = np.array([r["v"] for r in first], float), list(range(len(first)))
    for _ in range(rounds):
        cells = ivf.assigned(vectors, cids, centroids, id_col, vec)
        new = {r["cid"]: r["c"] for r in ivf.means(cells, "cid", vec).collect()}
        centroids = np.array([new.get(c, np.zeros(centroids.shape[1]) if empty_as_zero else centroids[c]) for c in cids], float)
    return vectors.sparkSession.createDataFrame([(c, x.tolist()) for c, x in zip(cids, centroids, strict=True)], "cid long, c array<double>")


def sample(rows: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    """``n`` rows without replacement, the same ones each time: those with the smallest hashes of the id."""
    return rows.orderBy(F.md5(F.col(id_col).cast("string").cast("binary")), id_col).limit(n)


def training_sample(rows: DataFrame, ratio: float, id_col: str = "id") -> DataFrame:
    """About ``ratio`` of the rows, chosen by the first 32 bits of the id's MD5, and at least one."""
    bound = int(min(1.0, max(0.0, ratio)) * 2**32)
    chosen = rows.withColumn("_h", F.conv(F.substring(F.md5(F.col(id_col).cast("string").cast("binary")), 1, 8), 16, 10).cast("long"))
    least = chosen.agg(F.min("_h").alias("_least"))
    return chosen.join(F.broadcast(least)).where((F.col("_h") < bound) | (F.col("_h") == F.col("_least"))).drop("_h", "_least")


def silhouette_rank(cells: DataFrame) -> DataFrame:
    """Vectors of each cell by distance to its centroid, from 1."""
    return cells.withColumn("rank", F.row_number().over(Window.partitionBy("cid").orderBy("d2")))
