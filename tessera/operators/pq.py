"""Product quantization: codebooks per part of the vector, codes, and distances from tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import ivf, kmeans, knn
from tessera.sources.store import Store

#: Codewords per part, at most: a code fits a byte.
MOST_CODES = 256


def _check(book: np.ndarray) -> None:
    if book.ndim != 3 or book.shape[1] > MOST_CODES:
        raise ValueError(f"a codebook is parts x codes x components, with {MOST_CODES} codes at most")


def train(vectors: DataFrame, parts: int, codes: int, iterations: int = 25, seed: int = 42, vec: str = "vec") -> np.ndarray:
    """A codebook (parts x codes x components) by k-means on each part."""
    size = len(vectors.select(vec).first()[0])
    if size % parts:
        raise ValueError(f"{size} components can't be cut into {parts} equal parts")
    step = size // parts
    cut = [vectors.select(F.slice(vec, 1 + i * step, step).alias("vec")) for i in range(parts)]
    return np.stack([kmeans.fit(c, codes, iterations, seed=seed) for c in cut])


def lloyd_codebook(vectors: DataFrame, parts: int, codes: int, rounds: int, id_col: str = "id", vec: str = "vec") -> np.ndarray:
    """A codebook begun with the vectors of the smallest ids, after a fixed number of rounds.

    Each round is one pass over the vectors for all parts together, which adds up the members of each
    codeword block by block; the codebook comes to the driver in between. Codewords without members
    become zeros.
    """
    rows = vectors.select(F.col(vec).cast("array<double>").alias("_vec"))
    first = vectors.select(id_col, F.col(vec).cast("array<double>").alias("v")).orderBy(id_col).limit(codes).collect()
    book = from_vectors([r["v"] for r in first], parts)
    size, step = book.shape[0] * book.shape[2], book.shape[2]
    for _ in range(rounds):

        def add(batches: Iterator[pa.RecordBatch], book: np.ndarray = book) -> Iterator[pa.RecordBatch]:
            total, members = np.zeros(book.shape), np.zeros(book.shape[:2], np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    block = batch.slice(at, 4096)
                    block = block.filter(pa.array([n == size for n in block.column("_vec").value_lengths().to_pylist()], pa.bool_()))
                    x = block.column("_vec").flatten().to_numpy(zero_copy_only=False).reshape(block.num_rows, parts, step)
                    for p in range(parts if block.num_rows else 0):
                        code, _ = ivf.nearest_cell(x[:, p], book[p])
                        np.add.at(total[p], code, x[:, p])
                        members[p] += np.bincount(code, minlength=book.shape[1])
            part, code = np.nonzero(members)
            words = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * step), pa.array(total[part, code].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(code.astype(np.int32)), pa.array(members[part, code]), words], ["part", "code", "n", "word"])

        sums = rows.mapInArrow(add, "part int, code int, n long, word array<double>").select("part", "code", "n", F.posexplode("word").alias("i", "x"))
        book = np.zeros(book.shape)
        for r in sums.groupBy("part", "code", "i").agg((F.sum("x") / F.sum("n")).alias("x")).collect():  # the size of the codebook
            book[r["part"], r["code"], r["i"]] = r["x"]
    return book


def from_vectors(rows: Sequence[Sequence[float]], parts: int) -> np.ndarray:
    """A codebook whose codewords are the parts of the given vectors."""
    x = np.array(rows, float)
    return x.reshape(len(x), parts, -1).transpose(1, 0, 2)


def book_table(spark: SparkSession, book: np.ndarray) -> DataFrame:
    """A codebook as ``part``, ``code`` and ``word``, to be written."""
    _check(book)
    rows = [(p, c, word.tolist()) for p, part in enumerate(book) for c, word in enumerate(part)]
    return spark.createDataFrame(rows, "part int, code int, word array<double>")


def book_of(table: DataFrame) -> np.ndarray:
    """The codebook that ``book_table`` was made from; its size is bounded by codes and dimension."""
    rows = table.orderBy("part", "code").collect()
    parts = max(r["part"] for r in rows) + 1
    if len(rows) % parts or len(rows) // parts > MOST_CODES:
        raise ValueError(f"every part needs as many codes, {MOST_CODES} at most")
    return np.array([r["word"] for r in rows], float).reshape(parts, len(rows) // parts, -1)


def train_version(store: Store, name: str, vectors: DataFrame, parts: int, codes: int, rounds: int = 5, id_col: str = "id", vec: str = "vec") -> int:
    """Train a codebook and keep it in ``store`` as the next version of ``name``; gives its number, from 1."""
    _check(np.zeros((parts, codes, 0)))
    version = 1 + max(versions_of(store, name), default=0)
    store.create(f"{name}-{version}", book_table(vectors.sparkSession, lloyd_codebook(vectors, parts, codes, rounds, id_col, vec)))
    return version


def versions_of(store: Store, name: str) -> list[int]:
    """The versions of a codebook that ``store`` holds, ascending."""
    numbers = [t.removeprefix(f"{name}-") for t in store.tables() if t.startswith(f"{name}-")]
    return sorted(int(n) for n in numbers if n.isdigit())


def encoded(vectors: DataFrame, book: np.ndarray, id_col: str = "id", vec: str = "vec", digits: int = 9) -> DataFrame:
    """``id_col`` and ``codes`` (array of int): the nearest codeword of each part, ties to the smaller."""
    _check(book)
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(vec).cast("array<double>").alias("_vec"))
    kind, (parts, _, step) = rows.schema["_id"].dataType.simpleString(), book.shape

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                block = batch.slice(at, 2048)
                block = block.filter(pa.array([n == parts * step for n in block.column("_vec").value_lengths().to_pylist()], pa.bool_()))
                x = block.column("_vec").flatten().to_numpy(zero_copy_only=False).reshape(block.num_rows, parts, step)
                codes = np.stack([np.round(((x[:, p, None, :] - book[p][None]) ** 2).sum(axis=2), digits).argmin(axis=1) for p in range(parts)], axis=1)
                offsets = pa.array(np.arange(block.num_rows + 1, dtype=np.int32) * parts)
                yield pa.RecordBatch.from_arrays([block.column("_id"), pa.ListArray.from_arrays(offsets, pa.array(codes.ravel().astype(np.int32)))], ["_id", "codes"])

    return rows.mapInArrow(encode, f"_id {kind}, codes array<int>").withColumnRenamed("_id", id_col)


def distance_table(query: Sequence[float], book: np.ndarray) -> np.ndarray:
    """Squared distances of the query's parts to all codewords (parts x codes)."""
    q = np.array(query, float).reshape(book.shape[0], 1, -1)
    return ((book - q) ** 2).sum(axis=2)


def with_distance(codes: DataFrame, query: Sequence[float], book: np.ndarray, codes_col: str = "codes") -> DataFrame:
    """``codes`` with ``distance``: the sum of the table's squared distances for each part's code."""
    table = distance_table(query, book)
    literal = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in table])
    d = F.aggregate(
        F.transform(F.col(codes_col), lambda c, i: F.get(F.get(literal, i), c)), F.lit(0.0), lambda s, x: s + x
    )
    return codes.withColumn("distance", d)


def search(codes: DataFrame, query: Sequence[float], book: np.ndarray, k: int, id_col: str = "id") -> DataFrame:
    """The ``k`` nearest by table distance, with ``similarity`` 1 / (1 + distance)."""
    out = with_distance(codes, query, book).withColumn("similarity", 1 / (1 + F.col("distance")))
    return out.orderBy(F.round("distance", 9), id_col).limit(k)


def decoded(codes: DataFrame, book: np.ndarray, codes_col: str = "codes") -> DataFrame:
    """``codes`` with ``vec``: the codewords in a row."""
    literal = F.array(*[F.array(*[F.array(*[F.lit(float(x)) for x in word]) for word in part]) for part in book])
    return codes.withColumn("vec", F.flatten(F.transform(F.col(codes_col), lambda c, i: F.get(F.get(literal, i), c))))


def table_distances(q: np.ndarray, x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Table distances of each row of ``q`` to the code of each row of ``x``."""
    parts, _, step = book.shape
    out = np.zeros((len(q), len(x)))
    for p in range(parts):
        part = slice(p * step, (p + 1) * step)
        code = np.round(((x[:, None, part] - book[p][None]) ** 2).sum(axis=2), 9).argmin(axis=1)
        out += ((q[:, None, part] - book[p][None]) ** 2).sum(axis=2)[:, code]
    return np.round(out, 9)


def batch(
    vectors: DataFrame, queries: Sequence[tuple[object, Sequence[float]]], book: np.ndarray, k: int, coarse: int, id_col: str = "id", vec: str = "vec"
) -> DataFrame:
    """The ``coarse`` nearest to each query by table distance, ranked anew by cosine, as ``knn.batch``; ``k`` at most."""
    _check(book)
    rough = knn.batch(vectors, queries, coarse, lambda q, x: table_distances(q, x, book), id_col, vec).select("query_id", id_col)
    asked = vectors.sparkSession.createDataFrame([(i, [float(x) for x in v]) for i, v in queries], "query_id long, _q array<double>")
    both = rough.join(vectors.select(id_col, vec), id_col).join(F.broadcast(asked), "query_id")
    found = both.select("query_id", id_col, (F.lit(1.0) - V.cosine(F.col(vec), F.col("_q"))).alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", id_col))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", id_col, "distance")
