"""Choosing a search strategy from the table's size, the dimension and what the caller asks for."""

from __future__ import annotations

from dataclasses import dataclass, field

BRUTE, IVF, HNSW, PQ, HYBRID, LSH, ENHANCED_IVF, IVF_HNSW = "brute_force", "ivf", "hnsw", "pq", "hybrid", "enhanced_lsh", "enhanced_ivf", "ivf_hnsw"


@dataclass(frozen=True)
class Situation:
    """``ready``: the indexes that exist; ``milliseconds``: 0 for no limit; ``wide``: whether accelerated hardware is there."""

    vectors: int
    dimension: int
    quality: float = 0.8
    milliseconds: float = 0.0
    ready: frozenset[str] = field(default_factory=frozenset)
    wide: bool = False


def _first(s: Situation, *names: str) -> str | None:
    return next((n for n in names if n in s.ready or n in (BRUTE, HYBRID)), None)


def choose(s: Situation) -> str:
    """The first rule that holds and whose index is there; exact search if none does."""
    n, d, q, ms = s.vectors, s.dimension, s.quality, s.milliseconds
    hurried = 0 < ms
    rules = (
        (n < 1_000, (BRUTE,)),
        (n > 50_000 and d >= 256 and q > 0.75, (IVF_HNSW,)),
        (n > 10_000 and (q > 0.8 or 128 <= d <= 2_048), (ENHANCED_IVF,)),
        (n > 10_000 and (d > 512 or q < 0.85 and hurried and ms < 50), (LSH,)),
        (s.wide and n > 100_000, (IVF_HNSW, HYBRID)),
        (s.wide and n > 10_000 and q > 0.8, (HYBRID,)),
        (d > 2_048, (IVF_HNSW, LSH, PQ, HNSW)),
        (q > 0.9 and n > 10_000, (IVF_HNSW,)),
        (q > 0.9, (ENHANCED_IVF, HNSW)),
        (q > 0.9 and n < 100_000, (BRUTE,)),
        (hurried and ms < 10, (LSH, PQ)),
        (hurried and ms < 100 and q > 0.8, (IVF_HNSW,)),
        (hurried and ms < 100 and q > 0.7, (ENHANCED_IVF,)),
        (s.wide and n > 50_000, (IVF_HNSW, HYBRID)),
        (True, (IVF_HNSW, ENHANCED_IVF, LSH, HNSW, IVF, BRUTE)),
    )
    for holds, names in rules:
        if holds and (found := _first(s, *names)):
            return found
    return BRUTE


def hybrid_dispatch(vectors: int, dimension: int, indexed: bool, levels: bool = False) -> str:
    """Exact below 1,000 vectors or without an index, hashing above 1,000 components, else the inverted file."""
    return BRUTE if vectors < 1_000 or not indexed else LSH if dimension > 1_000 else "multi_level" if levels else IVF


def ivf_cells(vectors: int) -> int:
    return next((c for below, c in ((10_000, 100), (100_000, 256), (1_000_000, 1_024)) if vectors < below), 4_096)


def pq_parts(dimension: int) -> int:
    return next((p for least, p in ((512, 16), (256, 8), (128, 4)) if dimension >= least), 2)


def health(indexes: frozenset[str]) -> dict[str, bool]:
    """For each kind of index whether it is there."""
    return {k: k in indexes for k in (BRUTE, IVF, HNSW, PQ, LSH, ENHANCED_IVF, IVF_HNSW)}
