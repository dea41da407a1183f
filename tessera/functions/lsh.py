"""Locality-sensitive hashes of ``array<double>`` columns as expressions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import vectors as V

#: The prime modulus of MinHash.
PRIME = 2**31 - 1


def planes(tables: int, functions: int, dimension: int, seed: int = 42) -> np.ndarray:
    """Gaussian normals: tables x functions x dimension; every table has its own."""
    return np.random.default_rng(seed).normal(size=(tables, functions, dimension))


def hyperplane_hash(vec: Column, normals: Sequence[Sequence[float]], inclusive: bool = False) -> Column:
    """Bit i is set where the product with normal i is above 0 (or 0 as well, if ``inclusive``)."""
    if len(normals) > 62:
        raise ValueError("a hash has 62 bits at most")
    out = F.lit(0).cast("long")
    for i, n in enumerate(normals):
        d = V.dot(vec, n)
        out = out + F.when((d >= 0) if inclusive else (d > 0), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return out


def angular_hash(vec: Column, normal: Sequence[float]) -> Column:
    """1 where the product with the normal is 0 or more, else 0."""
    return (V.dot(vec, normal) >= 0).cast("long")


def projection_hash(vec: Column, a: Sequence[float], b: float, w: float) -> Column:
    """|floor((a . v + b) / w)|, the hash of random projections and p-stable Euclidean families."""
    return F.abs(F.floor((V.dot(vec, a) + F.lit(float(b))) / F.lit(float(w))))


def combined(hashes: Sequence[Column]) -> Column:
    """Exclusive or of the hashes, each rotated by its place modulo 64."""
    out = F.lit(0).cast("long")
    for i, h in enumerate(hashes):
        h, by = h.cast("long"), i % 64
        out = out.bitwiseXOR(F.shiftleft(h, by).bitwiseOR(F.shiftrightunsigned(h, 64 - by)) if by else h)
    return out


def minhash(features: Column, a: Sequence[int], b: Sequence[int]) -> Column:
    """Of an array of numbers from 0, the least of (a * f + b) mod 2**31 - 1 for each (a, b); null if empty."""
    reduced = F.transform(features, lambda f: f.cast("long") % F.lit(PRIME))

    def least(x: int, y: int) -> Column:
        return F.array_min(F.transform(reduced, lambda f: (f * F.lit(x).cast("long") + F.lit(y)) % F.lit(PRIME)))

    return F.array(*[least(x, y) for x, y in zip(a, b, strict=True)])


def vector_features(vec: Column) -> Column:
    """The features of MinHash on vectors: place * 1e6 plus the size of the component in millionths, zeros left out."""
    numbered = F.transform(vec, lambda x, i: F.when(F.abs(x) > 1e-9, i.cast("long") * 1_000_000 + F.floor(F.abs(x) * 1_000_000)))
    return F.filter(numbered, lambda f: f.isNotNull())


def jaccard_estimate(a: Column, b: Column) -> Column:
    """The share of equal slots of two signatures; 0 where lengths differ."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1.0).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), F.lit(0.0)).otherwise(same / F.nullif(F.size(a), F.lit(0)))


def probes(base: Column, radius: int, bits: int = 62) -> Column:
    """The hash and its neighbours, distinct.

    From 1: hashes one bit away. From 2: two of the low eight bits away, and the numbers next to it.
    From 3: the numbers two and three away. From 4: five fixed masks.
    """
    base = base.cast("long")
    masks: list[int] = [0]
    steps: list[int] = []
    if radius >= 1:
        masks += [1 << i for i in range(bits)]
    if radius >= 2:
        low = min(8, bits)
        masks += [(1 << i) | (1 << j) for i in range(low) for j in range(i + 1, low)]
        steps += [1, -1]
    if radius >= 3:
        steps += [2, -2, 3, -3]
    if radius >= 4:
        rng = np.random.default_rng(7)
        masks += [int(x) for x in rng.integers(1, 2 ** min(bits, 62), 5)]
    flips = F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: base.bitwiseXOR(m))
    if not steps:
        return F.array_distinct(flips)
    return F.array_distinct(F.concat(flips, F.transform(F.array(*[F.lit(s).cast("long") for s in steps]), lambda s: base + s)))
