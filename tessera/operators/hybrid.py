"""Merging vector results with scalar results, and a fluent query over both."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import knn


def intersect(vector: DataFrame, scalar: DataFrame, wv: float = 0.7, ws: float = 0.3) -> DataFrame:
    """Vector rows whose id is among the scalar ids."""
    return vector.join(scalar.select("id").distinct(), "id", "left_semi").select("id", "distance")


def union(vector: DataFrame, scalar: DataFrame, wv: float = 0.7, ws: float = 0.3) -> DataFrame:
    """Vector rows, and scalar ids that they lack at a distance of 1."""
    more = scalar.select("id").distinct().join(vector.select("id"), "id", "left_anti").withColumn("distance", F.lit(1.0))
    return vector.select("id", "distance").unionByName(more)


def _first(rows: DataFrame, others: DataFrame) -> DataFrame:
    """``rows``, or ``others`` if there are none; decided inside the plan, by one row."""
    some = rows.limit(1).agg(F.count("*").alias("_n"))
    return rows.unionByName(others.join(F.broadcast(some.where("_n = 0").select(F.lit(1).alias("_e"))), how="cross").drop("_e"))


def vector_first(vector: DataFrame, scalar: DataFrame, wv: float = 0.7, ws: float = 0.3) -> DataFrame:
    """Vector rows, or the scalar ids at a distance of 1 if there are none."""
    return _first(vector.select("id", "distance"), scalar.select("id").distinct().withColumn("distance", F.lit(1.0)))


def scalar_first(vector: DataFrame, scalar: DataFrame, wv: float = 0.7, ws: float = 0.3) -> DataFrame:
    """Scalar ids at a distance of 0, or the vector rows if there are none."""
    return _first(scalar.select("id").distinct().withColumn("distance", F.lit(0.0)), vector.select("id", "distance"))


def weighted(vector: DataFrame, scalar: DataFrame, wv: float = 0.7, ws: float = 0.3) -> DataFrame:
    """``wv`` times the distance, plus a tenth of ``ws`` for ids in both; ``ws`` for scalar ids alone."""
    s = scalar.select("id").distinct().withColumn("_s", F.lit(True))
    both = vector.select("id", "distance").join(s, "id", "full_outer")
    d = F.when(F.col("distance").isNull(), F.lit(ws)).otherwise(
        F.col("distance") * F.lit(wv) + F.when(F.col("_s"), F.lit(0.1 * ws)).otherwise(F.lit(0.0))
    )
    return both.select("id", d.alias("distance"))


STRATEGIES = {"intersection": intersect, "union": union, "vector_first": vector_first, "scalar_first": scalar_first, "weighted": weighted}


def merge(vector: DataFrame, scalar: DataFrame, strategy: str = "intersection", wv: float = 0.7, ws: float = 0.3) -> DataFrame:
    """Merge (id, distance) with (id); an unknown strategy is an intersection."""
    return STRATEGIES.get(strategy, intersect)(vector, scalar, wv, ws)


def predicate(name: str, operator: str, value: object = None) -> Column:
    """One of the fourteen comparisons of a field with a value."""
    c = F.col(name)
    if operator in ("in", "not_in"):
        inside = c.isin(list(value))
        return inside if operator == "in" else ~inside
    if operator in ("contains", "not_contains"):
        inside = F.coalesce(c.cast("string").contains(str(value)), F.lit(False))
        return inside if operator == "contains" else ~inside
    simple = {
        "eq": lambda: c == value, "ne": lambda: c != value, "gt": lambda: c > value, "gte": lambda: c >= value, "lt": lambda: c < value,
        "lte": lambda: c <= value, "like": lambda: c.like(value), "not_like": lambda: ~c.like(value), "is_null": c.isNull, "is_not_null": c.isNotNull,
    }
    if operator not in simple:
        raise ValueError(f"unknown operator: {operator!r}")
    return simple[operator]()


@dataclass(frozen=True)
class Query:
    """A hybrid query, built step by step; every step gives a new query."""

    conditions: tuple[tuple[str, Column], ...] = ()
    vector: tuple[tuple[float, ...], int, str] | None = None
    order: tuple[tuple[str, bool], ...] = ()
    size: int = 0
    skip: int = 0
    strategy: str = "intersection"
    weights: tuple[float, float] = field(default=(0.7, 0.3))

    def _with(self, **changes) -> Query:
        return Query(**{**self.__dict__, **changes})

    def where(self, name: str, operator: str, value: object = None) -> Query:
        return self._with(conditions=(*self.conditions, ("and", predicate(name, operator, value))))

    def either(self, name: str, operator: str, value: object = None) -> Query:
        return self._with(conditions=(*self.conditions, ("or", predicate(name, operator, value))))

    def unless(self, name: str, operator: str, value: object = None) -> Query:
        return self._with(conditions=(*self.conditions, ("and", ~predicate(name, operator, value))))

    def near(self, query: Sequence[float], k: int, metric: str = "cosine") -> Query:
        return self._with(vector=(tuple(map(float, query)), k, metric))

    def order_by(self, name: str, descending: bool = False) -> Query:
        return self._with(order=(*self.order, (name, descending)))

    def limit(self, n: int) -> Query:
        return self._with(size=n)

    def offset(self, n: int) -> Query:
        return self._with(skip=n)

    def merged_by(self, strategy: str, wv: float = 0.7, ws: float = 0.3) -> Query:
        return self._with(strategy=strategy, weights=(wv, ws))

    def condition(self) -> Column | None:
        """The conditions from left to right, each joined to what stands before it."""
        return reduce(lambda a, b: a & b[1] if b[0] == "and" else a | b[1], self.conditions[1:], self.conditions[0][1]) if self.conditions else None

    def run(self, rows: DataFrame, id_col: str = "id", vec: str = "vec") -> DataFrame:
        """``rows`` that the query finds, with ``distance``, ordered (by distance and id unless told otherwise) and paged."""
        where = self.condition()
        if self.vector is None or where is None or self.strategy == "intersection":
            # One scan: the rows that are found are filtered where they are.
            out = rows.withColumn("distance", F.lit(0.0)) if self.vector is None else knn.nearest(rows, *self.vector, id_col, vec)
            return self._paged(out if where is None else out.where(where), rows, id_col)
        scalar = rows.where(where).select(F.col(id_col).alias("id"))
        found = knn.nearest(rows, *self.vector, id_col, vec).select(F.col(id_col).alias("id"), "distance")
        out = merge(found, scalar, self.strategy, *self.weights)
        return self._paged(rows.join(out.withColumnRenamed("id", id_col), id_col), rows, id_col)

    def _paged(self, out: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
        out = out.select(*rows.columns, "distance")
        keys = [F.desc_nulls_first(c) if down else F.asc_nulls_last(c) for c, down in self.order] or [F.asc("distance")]
        out = out.orderBy(*keys, F.asc(id_col))
        if self.skip:
            out = out.offset(self.skip)
        return out.limit(self.size) if self.size > 0 else out


def with_fallback(vector: DataFrame, keyword: DataFrame, id_col: str = "id") -> DataFrame:
    """Vector rows whose id the keywords found too; all keyword ids, with a null distance, if that leaves none."""
    both = vector.join(keyword.select(id_col).distinct(), id_col, "left_semi").select(id_col, "distance")
    return _first(both, keyword.select(id_col).distinct().withColumn("distance", F.lit(None).cast("double")))


def first_of_each(results: DataFrame, id_col: str = "id", order: str = "distance") -> DataFrame:
    """Of the results for one id, the first by ``order``."""
    return results.groupBy(id_col).agg(F.min(order).alias(order))


def top_of_shards(results: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """The ``k`` nearest of several shards' results, each id once."""
    return first_of_each(results, id_col).orderBy("distance", id_col).limit(k)
