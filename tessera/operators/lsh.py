"""Approximate search through hash buckets: an equi-join on (table, hash), then an exact ranking."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import lsh as H
from tessera.operators import knn


def hashes(x: np.ndarray, normals: np.ndarray) -> np.ndarray:
    """For each row of ``x`` and table, the hash whose bit i says whether the product with normal i is above 0."""
    if normals.shape[1] > 62:
        raise ValueError("a hash has 62 bits at most")
    bits = np.einsum("nd,tfd->ntf", x, normals) > 0
    return (bits.astype(np.int64) << np.arange(normals.shape[1])).sum(axis=2)


def index(vectors: DataFrame, normals: np.ndarray, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """``id_col``, ``table_id``, ``hash``: one row per vector and table. Bucket or partition it by (table_id, hash).

    Null vectors and those of another length have no rows.
    """
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vec).cast("array<double>").alias("_vec"))
    kind, (tables, _, size) = rows.schema["_id"].dataType.simpleString(), normals.shape

    def put(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 4096):
                block = part.slice(at, 4096)
                block = block.filter(pa.array([n == size for n in block.column("_vec").value_lengths().to_pylist()], pa.bool_()))
                x = block.column("_vec").flatten().to_numpy(zero_copy_only=False).reshape(block.num_rows, size)
                offsets = pa.array(np.arange(block.num_rows + 1, dtype=np.int32) * tables)
                listed = pa.ListArray.from_arrays(offsets, pa.array(hashes(x, normals).ravel()))
                yield pa.RecordBatch.from_arrays([block.column("_id"), listed], ["_id", "hashes"])

    out = rows.mapInArrow(put, f"_id {kind}, hashes array<long>")
    return out.select(F.col("_id").alias(id_col), F.posexplode("hashes").alias("table_id", "hash"))


def query_probes(spark: SparkSession, query: Sequence[float], normals: np.ndarray, radius: int = 0) -> DataFrame:
    """``table_id``, ``hash``: the buckets that a query looks into; a few hundred rows a table at most."""
    own = hashes(np.array([query], float), normals)[0].tolist()
    base = spark.range(1).select(F.posexplode(F.array(*[F.lit(h).cast("long") for h in own])).alias("table_id", "base"))
    return base.select("table_id", F.explode(H.probes(F.col("base"), radius, normals.shape[1])).alias("hash"))


def candidates(indexed: DataFrame, probes: DataFrame, id_col: str = "id") -> DataFrame:
    """The ids in any of the probed buckets, once each."""
    return indexed.join(F.broadcast(probes), ["table_id", "hash"], "left_semi").select(id_col).distinct()


def search(
    vectors: DataFrame, indexed: DataFrame, query: Sequence[float], normals: np.ndarray, k: int, radius: int = 0, id_col: str = "id", vec: str = "vec"
) -> DataFrame:
    """The ``k`` nearest by cosine among the candidates; among all vectors if there are none."""
    found = candidates(indexed, query_probes(vectors.sparkSession, query, normals, radius), id_col)
    some = vectors.join(found, id_col, "left_semi")
    if not found.take(1):
        some = vectors
    return knn.nearest(some, query, k, "cosine", id_col, vec)


def batch(
    vectors: DataFrame, queries: Sequence[tuple[object, Sequence[float]]], normals: np.ndarray, k: int, radius: int = 0, id_col: str = "id", vec: str = "vec"
) -> DataFrame:
    """As ``knn.batch``, among the vectors whose hash in some table differs from the query's in ``radius`` bits at most."""

    def among(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        a, b = hashes(q, normals), hashes(x, normals)
        out = np.zeros((len(q), len(x)), bool)
        for t in range(normals.shape[0]):
            out |= np.bitwise_count(a[:, t, None] ^ b[None, :, t]) <= radius
        return out

    return knn.batch(vectors, queries, k, "cosine", id_col, vec, among=among)
