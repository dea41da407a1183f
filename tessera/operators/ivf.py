"""Inverted-file search: vectors in cells around centroids, of which a query visits the nearest few.

Centroids are a small list (``MOST_CELLS`` at most, checked) that goes to the tasks as literals; the
assignment is a narrow projection in numpy. Write assigned vectors partitioned by ``cid`` and a
query reads only the cells that it visits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import knn

#: Centroids that are sent to the tasks, at most: 65,536 of 1,024 components are 0.5 GB.
MOST_CELLS = 65_536
#: Centroids that a block of vectors is held against at a time.
CELL_TILE = 1024


def collect_centroids(centroids: DataFrame, cid: str = "cid", vec: str = "c") -> tuple[list, np.ndarray]:
    """The centroids, ordered by id, after a check of their number."""
    rows = centroids.select(cid, F.col(vec).cast("array<double>")).orderBy(cid).limit(MOST_CELLS + 1).collect()
    if len(rows) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} centroids")
    return [r[0] for r in rows], np.array([r[1] for r in rows], float)


def means(vectors: DataFrame, by: str, vec: str = "vec") -> DataFrame:
    """``cid`` and ``c``: the element-wise mean of the vectors of each value of ``by``."""
    parts = vectors.select(F.col(by).alias("cid"), F.posexplode(vec).alias("at", "x")).groupBy("cid", "at").agg(F.avg("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "x")))
    return parts.groupBy("cid").agg(F.transform(ordered, lambda s: s["x"]).alias("c"))


def nearest_cell(x: np.ndarray, centroids: np.ndarray, digits: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` its nearest centroid, the first of several, and the squared distance.

    Matrix products, a tile of centroids at a time, leave few centroids that may be the nearest;
    those are measured exactly.
    """
    norms, own = (centroids**2).sum(axis=1), (x**2).sum(axis=1)
    best, least = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    for a in range(0, len(centroids), CELL_TILE):
        c = centroids[a : a + CELL_TILE]
        rough = own[:, None] - 2 * (x @ c.T) + norms[None, a : a + CELL_TILE]
        slack = 1e-9 * (own[:, None] + norms[None, a : a + CELL_TILE]) + 10.0**-digits
        row, col = np.nonzero(rough <= np.minimum(rough.min(axis=1), least)[:, None] + 2 * slack)
        d2 = ((x[row] - c[col]) ** 2).sum(axis=1)
        order = np.lexsort((col, np.round(d2, digits), row))
        first = order[np.r_[True, row[order][1:] != row[order][:-1]]] if len(order) else order
        nearer = first[np.round(d2[first], digits) < np.round(least[row[first]], digits)]
        best[row[nearer]], least[row[nearer]] = col[nearer] + a, d2[nearer]
    return best, least


def assigned(vectors: DataFrame, cids: Sequence, centroids: np.ndarray, id_col: str = "id", vec: str = "vec", digits: int = 9) -> DataFrame:
    """``id_col``, ``vec``, ``cid`` and ``d2``: the nearest centroid by squared distance, ties by its id.

    Distances are compared to ``digits`` decimals, so that ties don't hang on the order of a sum.
    """
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vec).cast("array<double>").alias("_vec"))
    kind = rows.schema["_id"].dataType.simpleString()
    cid_type = "long" if all(isinstance(c, int) for c in cids) else "string"

    def nearest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 1024):
                block = part.slice(at, 1024)
                block = block.filter(pa.array([n == centroids.shape[1] for n in block.column("_vec").value_lengths().to_pylist()], pa.bool_()))
                if not block.num_rows:
                    continue
                x = block.column("_vec").flatten().to_numpy(zero_copy_only=False).reshape(block.num_rows, -1)
                best, least = nearest_cell(x, centroids, digits)
                yield pa.RecordBatch.from_arrays(
                    [block.column("_id"), block.column("_vec"), pa.array([cids[i] for i in best.tolist()]), pa.array(least)],
                    ["_id", "_vec", "cid", "d2"],
                )

    out = rows.mapInArrow(nearest, f"_id {kind}, _vec array<double>, cid {cid_type}, d2 double")
    return out.withColumnRenamed("_id", id_col).withColumnRenamed("_vec", vec)


def probes(query: Sequence[float], cids: Sequence, centroids: np.ndarray, nprobe: int, metric: str = "l2") -> list:
    """The ids of the ``nprobe`` nearest centroids, at least one, ties by id."""
    d = np.round(knn.distances(np.array([query], float), centroids, metric)[0], 9)
    order = sorted(range(len(cids)), key=lambda i: (d[i], cids[i]))
    return [cids[i] for i in order[: max(1, min(nprobe, len(cids)))]]


def search(cells: DataFrame, query: Sequence[float], k: int, visit: Sequence, metric: str = "cosine", id_col: str = "id", vec: str = "vec") -> DataFrame:
    """The ``k`` nearest in the cells ``visit``; a filter on ``cid`` that prunes partitions."""
    return knn.nearest(cells.where(F.col("cid").isin(list(visit))), query, k, metric, id_col, vec)


def grouped_cells(centroids: np.ndarray, groups: int, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(centroids of the upper level, the group of each cell): Lloyd rounds over the centroids, begun with the first ones."""
    tops = centroids[:groups].copy()
    for _ in range(rounds):
        of, _ = nearest_cell(centroids, tops)
        tops = np.array([centroids[of == g].mean(axis=0) if (of == g).any() else tops[g] for g in range(len(tops))])
    return tops, nearest_cell(centroids, tops)[0]


def probes_by_level(query: Sequence[float], cids: Sequence, centroids: np.ndarray, tops: np.ndarray, of: np.ndarray, ntop: int, nprobe: int) -> list:
    """The ``nprobe`` nearest cells among those of the ``ntop`` nearest groups."""
    near = set(probes(query, range(len(tops)), tops, ntop))
    inside = [i for i in range(len(cids)) if of[i] in near]
    return probes(query, [cids[i] for i in inside], centroids[inside], nprobe) if inside else []


def metrics(cells: DataFrame, all_cids: DataFrame | None = None) -> DataFrame:
    """``cid``, ``n``, ``variance`` (mean squared distance), ``radius`` (largest distance), ``density``.

    The density is n / (1 + radius), n where the radius is 0, and 0 for a cell without vectors.
    """
    out = cells.groupBy("cid").agg(F.count("*").alias("n"), F.avg("d2").alias("variance"), F.sqrt(F.max("d2")).alias("radius"))
    if all_cids is not None:
        out = all_cids.select("cid").join(out, "cid", "left").na.fill(0, ["n", "variance", "radius"])
    return out.withColumn("density", F.when(F.col("radius") == 0, F.col("n").cast("double")).otherwise(F.col("n") / (1 + F.col("radius"))))


def candidate_cells(measured: DataFrame, centroids: DataFrame, query: Sequence[float], nprobe: int, ideal: float) -> DataFrame:
    """Cells by distance, then density, then how near their size is to ``ideal``, then id."""
    d = F.round(V.l2_squared(F.col("c"), query), 9)
    return (
        measured.join(centroids, "cid")
        .withColumn("distance", d)
        .orderBy("distance", F.desc("density"), F.abs(F.col("n") - F.lit(float(ideal))), "cid")
        .limit(nprobe)
    )


def adaptive_nprobe_by_balance(sizes: Sequence[int], base: int, largest_allowed: int, queried: bool = False) -> int:
    """``base`` scaled by how even the cells are, how large the largest is and whether it has been queried."""
    if not sizes:
        return 1
    ratio = min(sizes) / max(max(sizes), 1)
    factor = 0.8 if ratio < 0.1 else 1.5 if ratio > 0.5 else 1.0
    factor *= 1.3 if max(sizes) > largest_allowed / 2 else 1.0
    factor *= 1.2 if queried else 1.0
    return max(1, min(len(sizes), int(base * factor)))


def adaptive_nprobe_by_size(vectors: int, cells: int) -> int:
    for below, least, share in ((1e4, 1, 1 / 4), (1e5, 2, 1 / 3), (1e6, 3, 1 / 2)):
        if vectors < below:
            return max(least, math.floor(cells * share + 1e-9))
    return max(5, cells * 2 // 3)


def static_nprobe(vectors: int, cells: int) -> int:
    return cells // 10 if vectors > 1e6 else cells // 20 if vectors > 1e5 else max(1, cells // 50)


def needs_rebuild(cells: DataFrame, least: int, most: int) -> bool:
    """Whether any cell has fewer than ``least`` or more than ``most`` vectors."""
    sizes = cells.groupBy("cid").count()
    return sizes.where((F.col("count") < least) | (F.col("count") > most)).limit(1).count() > 0


def batch(
    vectors: DataFrame,
    queries: Sequence[tuple[object, Sequence[float]]],
    centroids: np.ndarray,
    k: int,
    nprobe: int,
    id_col: str = "id",
    vec: str = "vec",
) -> DataFrame:
    """As ``knn.batch``, among the vectors in the ``nprobe`` cells nearest to each query; centroids in the order of their ids."""

    def among(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        near = np.round(knn.distances(q, centroids, "l2"), 9).argsort(axis=1, kind="stable")[:, :nprobe]
        visits = np.zeros((len(q), len(centroids)), bool)
        visits[np.arange(len(q))[:, None], near] = True
        return visits[:, nearest_cell(x, centroids)[0]]

    return knn.batch(vectors, queries, k, "cosine", id_col, vec, among=among)
