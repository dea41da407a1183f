"""Document quality by regularised quadratic discriminant analysis.

Each class is a Gaussian over a few transformed statistics of the whole text. A class's covariance
is shrunk towards the pooled one and that towards a multiple of the identity, so that a statistic
which is constant in one class doesn't make it singular. A document's score comes from the
difference of the two log-densities, each a Mahalanobis distance taken through the class's Cholesky
factor, which is computed once on the driver (its size is that of the list of statistics).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import batches, words
from tessera.plans.durable import durable
from tessera.sources.tables import table

STATISTICS = ("shouting", "exclaiming", "symbols", "poverty", "stutter")
#: Shares of the pooled covariance and of the identity.
TO_POOLED, TO_IDENTITY = 0.5, 0.1
#: A document is predicted good from this score on.
THRESHOLD = 0.3
#: Of five folds of crc32(id), this one is held out of training.
FOLDS, HELD_OUT = 5, 0

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*+<=>[\\]^`{|}~")] = True


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` for each text, each from 0 (plain prose, or no words) to 1."""
    w = words.split(column)
    n, texts = w.counts(), len(w.counts())
    size = np.maximum(np.diff(w.text_at), 1)

    def total(flags: np.ndarray) -> np.ndarray:
        return np.r_[0, np.cumsum(flags)]

    upper, other = total(_UPPER[w.data]), total(_LOWER[w.data] | _DIGIT[w.data])
    shouts = (upper[w.ends] - upper[w.starts] > 1) & (other[w.ends] == other[w.starts])
    owner, number = w.owner(), words.numbers(w)
    order = np.lexsort((number, owner))
    new = np.r_[True, (number[order][1:] != number[order][:-1]) | (owner[order][1:] != owner[order][:-1])][: len(number)]
    distinct = np.bincount(owner[order][new], minlength=texts)
    again = (number[1:] == number[:-1]) & (owner[1:] == owner[:-1])
    per_text = lambda flags: np.diff(total(flags)[w.text_at]) / size
    count = np.maximum(n, 1)
    out = np.empty((texts, len(STATISTICS)))
    out[:, 0] = np.sqrt(np.bincount(owner[shouts], minlength=texts) / count)
    out[:, 1] = np.sqrt(per_text(w.data == 33))
    out[:, 2] = np.sqrt(per_text(_SYMBOL[w.data]))
    # One less Herdan's ratio: about 0 for prose of any length, near 1 for few words said often.
    out[:, 3] = np.where(n > 1, 1 - np.log(np.maximum(distinct, 1)) / np.log(np.maximum(n, 2)), 0)
    out[:, 4] = np.sqrt(np.bincount(owner[1:][again], minlength=texts) / count)
    return out


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id`` and the statistics of each row of ``docs``; a null text counts as empty."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches.pieces(parts, "_text"):
            x = statistics(part.column("_text"))
            yield pa.RecordBatch.from_arrays([part.column("_id"), *map(pa.array, x.T)], ["_id", *STATISTICS])

    return rows.mapInArrow(measure, f"_id {kind}, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass
class Gaussian:
    """A class: log prior less the log root of the determinant, mean, and inverse Cholesky factor."""

    constant: float
    mean: np.ndarray
    whiten: np.ndarray


def discriminant(count: np.ndarray, total: np.ndarray, product: np.ndarray) -> list[Gaussian] | None:
    """The two classes from their counts, sums and sums of products; None if one has no rows."""
    if (count == 0).any():
        return None
    mean = total / count[:, None]
    spread = product - count[:, None, None] * mean[:, :, None] * mean[:, None, :]
    pooled = spread.sum(axis=0) / max(count.sum() - 2, 1)
    d = len(pooled)
    out = []
    for k in (0, 1):
        own = spread[k] / max(count[k] - 1, 1)
        mixed = (1 - TO_POOLED) * own + TO_POOLED * pooled
        ridge = max(np.trace(mixed) / d, 1e-9)
        shrunk = (1 - TO_IDENTITY) * mixed + TO_IDENTITY * ridge * np.eye(d)
        factor = np.linalg.cholesky((shrunk + shrunk.T) / 2)
        constant = math.log(count[k] / count.sum()) - np.log(np.diag(factor)).sum()
        out.append(Gaussian(float(constant), mean[k], np.linalg.inv(factor)))
    return out


def _log_density(g: Gaussian) -> Column:
    centred = [F.col(s) - F.lit(float(m)) for s, m in zip(STATISTICS, g.mean, strict=True)]
    white = [reduce(Column.__add__, [F.lit(float(g.whiten[i, j])) * centred[j] for j in range(i + 1)]) for i in range(len(centred))]
    return F.lit(g.constant) - F.lit(0.5) * reduce(Column.__add__, [x * x for x in white])


def is_held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def fit(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> list[Gaussian] | None:
    """The classes, from all labelled rows outside the held-out fold, by one aggregation.

    Labels other than 0 and 1, and ids with both, aren't learnt from.
    """
    given = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id"))
    given = given.agg(F.min(label_col).alias("_label"), F.max(label_col).alias("_other")).where("_label = _other")
    known = measured.where(~is_held_out(F.col("_id"))).join(given, "_id")
    d = len(STATISTICS)
    sums = [F.sum(s) for s in STATISTICS] + [F.sum(F.col(STATISTICS[i]) * F.col(STATISTICS[j])) for i in range(d) for j in range(i + 1)]
    count, total, product = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in known.groupBy("_label").agg(F.count("*"), *sums).collect():  # two rows at most
        k = int(r[0])
        count[k], total[k] = r[1], r[2 : 2 + d]
        for (i, j), x in zip([(i, j) for i in range(d) for j in range(i + 1)], r[2 + d :], strict=True):
            product[k, i, j] = product[k, j, i] = x
    return discriminant(count, total, product)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``id_col``, ``held_out``, ``score`` (0 to 1, higher: likelier good) and ``predicted`` (1: good).

    One row per row of ``docs``. The score is the logistic function of the log-density difference
    divided by the number of statistics: it orders documents as the posterior does and keeps the ends
    apart, but 0.3 of it is a posterior of about 0.014. Ids whose crc32 as text is divisible by 5 are held out of training;
    null ids are neither held out nor learnt from. Without rows of both classes to learn from, every
    score is 0.5. Other columns are ignored whatever their names.
    """
    measured = durable(with_statistics(docs, id_col, text_col))
    classes = fit(measured, labels, id_col, label_col)
    if classes is None:
        score = F.lit(0.5)
    else:
        # Divided by the number of statistics, so that scores at the ends stay apart.
        difference = (_log_density(classes[1]) - _log_density(classes[0])) / F.lit(float(len(STATISTICS)))
        score = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), difference))))
    return measured.select(F.col("_id").alias(id_col), is_held_out(F.col("_id")).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )


def difference(x: np.ndarray, classes: list[Gaussian]) -> np.ndarray:
    """The log-density of class 1 less that of class 0, for rows of statistics, as ``quality_scores`` scales it."""
    d = [g.constant - 0.5 * (((x - g.mean) @ g.whiten.T) ** 2).sum(axis=1) for g in classes]
    return (d[1] - d[0]) / len(STATISTICS)


def only_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of ``docs`` that are predicted good, all columns.

    The classes are learnt as in ``quality_scores``; rows are then judged where they are read, by
    their own text, without a shuffle. Without rows of both classes to learn from, all rows stay.
    """
    classes = fit(with_statistics(docs, id_col, text_col), labels, id_col, label_col)
    if classes is None:
        return docs
    least = math.log(THRESHOLD / (1 - THRESHOLD))

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches.pieces(parts, text_col):
            x = statistics(pc.cast(part.column(text_col), pa.string()))
            yield part.filter(pa.array(difference(x, classes) >= least))

    return docs.mapInArrow(judge, docs.schema)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op5_quality_classifier": op5_quality_classifier}
