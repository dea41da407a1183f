"""Nearest neighbours by exact search.

One query vector becomes a literal, so a search is a projection and a top-k: no join, no shuffle of
vectors. Many query vectors go through numpy, a block of vectors against all queries at a time, and
each block hands on its own k best per query only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions import vectors as V

#: Query vectors of a batch that are sent to the tasks, at most; more are searched in turns.
QUERY_BLOCK = 1024
#: Vectors that a task compares at a time.
VECTOR_BLOCK = 4096


#: A function of rows of queries and rows of vectors with a value for each pair.
Distances = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _check(k: int) -> None:
    if k <= 0:
        raise ValueError("k must be above 0")


def scored(vectors: DataFrame, query: V.Vector, metric: str = "cosine", vec: str = "vec") -> DataFrame:
    """``vectors`` with ``distance`` (smaller is nearer) and ``similarity``.

    The similarity is the cosine or dot product itself, or 1 / (1 + distance) for ``l2`` and ``l1``.
    """
    if metric in ("cosine", "dot"):
        both = vectors.withColumn("similarity", (V.cosine if metric == "cosine" else V.dot)(F.col(vec), query))
        return both.withColumn("distance", F.lit(1.0) - F.col("similarity") if metric == "cosine" else -F.col("similarity"))
    return vectors.withColumn("distance", V.distance(F.col(vec), query, metric)).withColumn("similarity", 1 / (1 + F.col("distance")))


def nearest(vectors: DataFrame, query: V.Vector, k: int, metric: str = "cosine", id_col: str = "id", vec: str = "vec") -> DataFrame:
    """The ``k`` rows nearest to ``query``, ties by id; vectors of another length don't count."""
    _check(k)
    return scored(vectors, query, metric, vec).where("distance is not null").orderBy("distance", id_col).limit(k)


def nearest_above(vectors: DataFrame, query: V.Vector, threshold: float, k: int | None = None, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """All rows with a cosine of ``threshold`` or more, in no order; with ``k``, the ``k`` nearest of them."""
    found = scored(vectors, query, "cosine", vec).where(F.col("similarity") >= threshold)
    if k is None:
        return found
    _check(k)
    return found.orderBy(F.desc("similarity"), id_col).limit(k)


def nearest_where(vectors: DataFrame, query: V.Vector, k: int, predicate: Column, first: bool = True, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """``first``: the ``k`` nearest of the rows that pass. Else those of the ``2 * k`` nearest that pass, ``k`` at most."""
    _check(k)
    if first:
        return nearest(vectors.where(predicate), query, k, "cosine", id_col, vec)
    return nearest(vectors, query, 2 * k, "cosine", id_col, vec).where(predicate).orderBy("distance", id_col).limit(k)


def two_stage(
    vectors: DataFrame, query: Sequence[float], k: int, coarse: int, prefix: int = 32, threshold: float | None = None, id_col: str = "id", vec: str = "vec"
) -> DataFrame:
    """The ``coarse`` nearest by the first ``prefix`` components, ranked anew by cosine; ``k`` at most.

    Vectors of fewer than 8 components are compared whole in the first stage, too.
    """
    _check(k)
    query = [float(x) for x in query]
    n = len(query) if len(query) < 8 else min(prefix, len(query))
    rough = V.l2_squared(F.slice(F.col(vec), 1, n), query[:n])
    some = vectors.withColumn("coarse_distance", rough).where("coarse_distance is not null").orderBy("coarse_distance", id_col).limit(coarse)
    out = scored(some, query, "cosine", vec)
    if threshold is not None:
        out = out.where(F.col("similarity") >= threshold)
    return out.orderBy("distance", id_col).limit(k)


def by_block(search: Callable[[Sequence, list[set] | None], DataFrame], queries: Sequence, visit: Sequence[Sequence] | None) -> DataFrame:
    """What ``search`` finds for queries and the cells they go to (None: all), ``QUERY_BLOCK`` at a time."""
    out = None
    for at in range(0, max(1, len(queries)), QUERY_BLOCK):
        cells = None if visit is None else [set(v) for v in visit[at : at + QUERY_BLOCK]]
        one = search(queries[at : at + QUERY_BLOCK], cells)
        out = one if out is None else out.unionByName(one)
    return out


def batch(
    vectors: DataFrame,
    queries: Sequence[tuple[object, Sequence[float]]],
    k: int,
    metric: str | Distances = "cosine",
    id_col: str = "id",
    vec: str = "vec",
    query_type: str = "long",
    among: Distances | None = None,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``id_col``, ``distance``: the ``k`` nearest to each query, ties by id.

    Queries are taken ``QUERY_BLOCK`` at a time. A task keeps ``k`` rows a query of each block of
    vectors; what is shuffled are those. Null vectors and those of another length don't count.
    ``among`` says, for rows of queries and of vectors, which vectors a query may find: an index's candidates.
    """
    _check(k)
    out = None
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vec).cast("array<double>").alias("_vec"))
    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"query_id {query_type}, _id {kind}, distance double"
    for at in range(0, max(1, len(queries)), QUERY_BLOCK):
        some = queries[at : at + QUERY_BLOCK]
        if not some:
            return vectors.sparkSession.createDataFrame([], f"query_id {query_type}, rank int, {id_col} {kind}, distance double")
        q = np.array([v for _, v in some], float)
        names = [i for i, _ in some]

        def best(parts: Iterator[pa.RecordBatch], q: np.ndarray = q, names: list = names) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for start in range(0, part.num_rows, VECTOR_BLOCK):
                    block = part.slice(start, VECTOR_BLOCK)
                    sizes = np.array([-1 if n is None else n for n in block.column("_vec").value_lengths().to_pylist()])
                    block = block.filter(pa.array(sizes == q.shape[1]))
                    if not block.num_rows:
                        continue
                    x = block.column("_vec").flatten().to_numpy(zero_copy_only=False).reshape(block.num_rows, -1)
                    d = metric(q, x) if callable(metric) else distances(q, x, metric)
                    may = ~np.isnan(d) if among is None else among(q, x) & ~np.isnan(d)
                    if among is not None:
                        d = np.where(may, d, np.inf)
                    if k < d.shape[1]:
                        # The k-th smallest of each query; all as near as it go on, so ties are whole.
                        keep = d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k]
                    else:
                        keep = np.ones(d.shape, bool)
                    i, j = np.nonzero(keep & may)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[a] for a in i.tolist()]), block.column("_id").take(pa.array(j)), pa.array(d[i, j])], ["query_id", "_id", "distance"]
                    )

        found = rows.mapInArrow(best, schema)
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("_id").alias(id_col), "distance")


def pairs(
    vectors: DataFrame, queries: Sequence[tuple[object, Sequence[float]]], metric: str = "cosine", id_col: str = "id", vec: str = "vec", query_type: str = "long"
) -> DataFrame:
    """``query_id``, ``id_col``, ``distance``: every vector against every query, without a shuffle.

    Queries are taken ``QUERY_BLOCK`` at a time. Null vectors and those of another length don't count.
    """
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vec).cast("array<double>").alias("_vec"))
    kind = rows.schema["_id"].dataType.simpleString()
    out = vectors.sparkSession.createDataFrame([], f"query_id {query_type}, _id {kind}, distance double")
    for at in range(0, len(queries), QUERY_BLOCK):
        some = queries[at : at + QUERY_BLOCK]
        q, names = np.array([v for _, v in some], float), pa.array([i for i, _ in some])

        def meet(parts: Iterator[pa.RecordBatch], q: np.ndarray = q, names: pa.Array = names) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for start in range(0, part.num_rows, 128):
                    block = part.slice(start, 128)
                    sizes = np.array([-1 if n is None else n for n in block.column("_vec").value_lengths().to_pylist()])
                    block = block.filter(pa.array(sizes == q.shape[1]))
                    if not block.num_rows:
                        continue
                    x = block.column("_vec").flatten().to_numpy(zero_copy_only=False).reshape(block.num_rows, -1)
                    d = distances(q, x, metric)
                    i, j = np.indices(d.shape)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(i.ravel())), block.column("_id").take(pa.array(j.ravel())), pa.array(d.ravel())], ["query_id", "_id", "distance"])

        found = rows.mapInArrow(meet, f"query_id {query_type}, _id {kind}, distance double")
        out = out.unionByName(found) if at else found
    return out.withColumnRenamed("_id", id_col)


def distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances of each row of ``q`` to each row of ``x``, as ``V.distance`` has them."""
    if metric == "dot":
        return -(q @ x.T)
    if metric == "cosine":
        norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
        return 1 - np.divide(q @ x.T, norms, out=np.zeros_like(norms), where=norms != 0)
    if metric in ("l2", "l1"):
        out = np.empty((len(q), len(x)))
        for i, row in enumerate(q):
            gap = x - row
            out[i] = np.sqrt((gap * gap).sum(axis=1)) if metric == "l2" else np.abs(gap).sum(axis=1)
        return out
    raise ValueError(f"unknown metric: {metric!r}")


def graph(vectors: DataFrame, m: int, metric: str = "l2", id_col: str = "id", vec: str = "vec", centres: int | None = None) -> DataFrame:
    """``src``, ``dst``, ``rank``, ``distance``: each vector's ``m`` nearest others, by exact comparison.

    Vectors are dealt into blocks by a hash of the id and every block meets every other in a task of
    its own, so memory stays bounded; the work is quadratic, as any exact graph's. ``ivf.assigned``
    and a join within cells is the way for larger tables.
    """
    _check(m)
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vec).cast("array<double>").alias("_vec"))
    kind = rows.schema["_id"].dataType.simpleString()
    id_type = to_arrow_type(rows.schema["_id"].dataType)
    n = max(1, -(-rows.count() // VECTOR_BLOCK))
    own = rows.withColumn("own", F.pmod(F.xxhash64("_id"), F.lit(n)).cast("int"))
    left = own.select(F.col("own").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("b"), "_id", "_vec")
    right = own.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("a"), F.col("own").alias("b"), F.col("_id").alias("_id2"), F.col("_vec").alias("_vec2"))

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:  # an empty side may come without columns
            return pa.table([pa.array([], id_type), pa.array([], id_type), pa.array([], pa.float64())], names=["src", "dst", "distance"])
        ids = [pa.concat_arrays(t.column(c).chunks) for t, c in ((x, "_id"), (y, "_id2"))]
        mats = [np.array(t.column(c).to_pylist(), float) for t, c in ((x, "_vec"), (y, "_vec2"))]
        d = distances(mats[0], mats[1], metric)
        same = np.array(ids[0].to_pylist(), object)[:, None] == np.array(ids[1].to_pylist(), object)[None, :]
        d[same.astype(bool)] = np.nan
        k = min(m, d.shape[1] - 1)
        edge = np.partition(np.where(np.isnan(d), np.inf, d), k, axis=1)[:, k : k + 1]
        i, j = np.nonzero(d <= edge)
        return pa.table([ids[0].take(pa.array(i)), ids[1].take(pa.array(j)), pa.array(d[i, j])], names=["src", "dst", "distance"])

    met = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(meet, f"src {kind}, dst {kind}, distance double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.round("distance", 9), "dst"))
    return met.withColumn("rank", rank).where(F.col("rank") <= m)
