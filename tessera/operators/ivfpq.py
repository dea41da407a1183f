"""Product quantization within the cells of an inverted file: codes of what is left after the centroid.

Residuals are small, so a codebook trained on them is finer than one of whole vectors. A query has a
table of distances for each cell that it visits, from its own residual there. Codes, codebook and
centroids are tables; written partitioned by ``cid``, a search reads only the cells that it visits.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import ivf, knn, pq


def residuals(cells: DataFrame, cids: Sequence, centroids: np.ndarray, vec: str = "vec") -> DataFrame:
    """``cells`` with ``vec`` less the centroid of its ``cid``."""
    small = cells.sparkSession.createDataFrame([(c, x.tolist()) for c, x in zip(cids, centroids, strict=True)], f"cid {cells.schema['cid'].dataType.simpleString()}, _c array<double>")
    both = cells.join(F.broadcast(small), "cid")  # ivf.MOST_CELLS rows at most
    return both.withColumn(vec, F.zip_with(vec, "_c", lambda x, c: x - c)).drop("_c")


def build(
    vectors: DataFrame, cids: Sequence, centroids: np.ndarray, parts: int, codes: int, rounds: int = 5, id_col: str = "id", vec: str = "vec"
) -> tuple[DataFrame, np.ndarray]:
    """(``id_col``, ``cid`` and ``codes`` of every vector, the codebook), trained on all residuals."""
    left = residuals(ivf.assigned(vectors, cids, centroids, id_col, vec), cids, centroids, vec).select(id_col, "cid", vec)
    book = pq.lloyd_codebook(left, parts, codes, rounds, id_col, vec)
    named = left.select(F.to_json(F.struct(id_col, "cid")).alias("_key"), vec)  # the key travels beside the codes
    out = pq.encoded(named, book, "_key", vec)
    fields = F.from_json("_key", f"{id_col} {vectors.schema[id_col].dataType.simpleString()}, cid {left.schema['cid'].dataType.simpleString()}")
    return out.select(fields.alias("_k"), "codes").select("_k.*", "codes"), book


def search(coded: DataFrame, query: Sequence[float], cids: Sequence, centroids: np.ndarray, book: np.ndarray, k: int, nprobe: int, id_col: str = "id") -> DataFrame:
    """The ``k`` nearest by table distance in the ``nprobe`` nearest cells, ties by id, with ``similarity`` 1 / (1 + distance)."""
    place = {c: i for i, c in enumerate(cids)}
    out = None
    for c in ivf.probes(query, cids, centroids, nprobe):
        one = pq.with_distance(coded.where(F.col("cid") == F.lit(c)), np.array(query, float) - centroids[place[c]], book)
        out = one if out is None else out.unionByName(one)
    return out.withColumn("similarity", 1 / (1 + F.col("distance"))).orderBy(F.round("distance", 9), id_col).limit(k)


def reranked(found: DataFrame, vectors: DataFrame, query: Sequence[float], k: int, metric: str = "l2", id_col: str = "id", vec: str = "vec") -> DataFrame:
    """The ``k`` nearest of the rows that a coarse search found, by exact distance."""
    return knn.nearest(vectors.join(F.broadcast(found.select(id_col)), id_col), query, k, metric, id_col, vec)


def batch(
    coded: DataFrame,
    vectors: DataFrame,
    queries: Sequence[tuple[int, Sequence[float]]],
    cids: Sequence,
    centroids: np.ndarray,
    book: np.ndarray,
    k: int,
    nprobe: int,
    coarse: int,
    id_col: str = "id",
    vec: str = "vec",
) -> DataFrame:
    """``query_id``, ``rank``, ``id_col``, ``distance``: the ``coarse`` nearest to each query by table distance, ranked anew by exact distance."""
    q = np.array([v for _, v in queries], float)
    near = np.round(knn.distances(q, centroids, "l2"), 9).argsort(axis=1, kind="stable")[:, :nprobe]
    place = F.create_map(*[x for i, c in enumerate(cids) for x in (F.lit(c), F.lit(float(i)))])
    rows = coded.select(id_col, F.concat(F.array(place[F.col("cid")]), F.col("codes").cast("array<double>")).alias("_row"))
    parts = book.shape[0]

    def table(asked: np.ndarray, row: np.ndarray) -> np.ndarray:
        cell, code = row[:, 0].astype(int), row[:, 1:].astype(int)
        out = np.full((len(asked), len(row)), np.nan)
        for j, i in enumerate(asked[:, 0].astype(int).tolist()):
            for c in near[i].tolist():
                here = np.flatnonzero(cell == c)
                if len(here):
                    t = pq.distance_table(q[i] - centroids[c], book)
                    out[j, here] = np.round(t[np.arange(parts), code[here]].sum(axis=1), 9)
        return out

    # What is handed on as a query is its number: the rows that it is held against are codes.
    numbers = [(name, [float(i)] + [0.0] * parts) for i, (name, _) in enumerate(queries)]
    rough = knn.batch(rows, numbers, coarse, table, id_col, "_row").select("query_id", id_col)
    asked = vectors.sparkSession.createDataFrame([(n, [float(x) for x in v]) for n, v in queries], "query_id long, _q array<double>")
    both = rough.join(vectors.select(id_col, vec), id_col).join(F.broadcast(asked), "query_id")
    found = both.select("query_id", id_col, V.l2(F.col(vec), F.col("_q")).alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 9), id_col))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", id_col, "distance")
