"""Principal components: one distributed pass for the covariance, the rest on a small matrix."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as V


@dataclass
class Components:
    mean: np.ndarray
    rows: np.ndarray  # components x dimensions, by descending variance
    variances: np.ndarray


def fit(vectors: DataFrame, target: int | None = None, ratio: float | None = None, vec: str = "vec") -> Components:
    """``target`` components, or as many as hold ``ratio`` of the variance; the first non-zero entry of each is positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    data = vectors.select(array_to_vector(F.col(vec).cast("array<double>")).alias("v"))
    mean, variance = data.select(Summarizer.mean(F.col("v")), Summarizer.variance(F.col("v"))).first()
    size = len(mean)
    model = PCA(k=size if target is None else target, inputCol="v", outputCol="p").fit(data)
    mean, rows = mean.toArray(), model.pc.toArray().T
    share = model.explainedVariance.toArray()
    values = share * variance.toArray().sum()
    if target is None:
        target = size if ratio is None else min(size, int(np.searchsorted(np.cumsum(share), ratio - 1e-12) + 1))
    rows = rows[:target]
    lead = np.array([r[np.flatnonzero(np.abs(r) > 1e-12)[0]] if np.abs(r).max() > 1e-12 else 1 for r in rows])
    return Components(mean, rows * np.sign(lead)[:, None], values[:target])


def applied(vectors: DataFrame, c: Components, vec: str = "vec", out: str = "reduced") -> DataFrame:
    """``vectors`` with ``out``: centred and projected."""
    centred = F.zip_with(V.as_vector(F.col(vec)), V.as_vector(c.mean.tolist()), lambda x, m: x - m)
    return vectors.withColumn("_c", centred).withColumn(out, F.array(*[V.dot(F.col("_c"), r.tolist()) for r in c.rows])).drop("_c")
