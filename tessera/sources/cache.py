"""Results kept under a key in a store, and which of them stay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.store import Store

#: What decides which entries stay, the best first.
POLICIES = {"lru": ("last_used",), "lfu": ("uses", "last_used"), "fifo": ("created",)}


def cached(store: Store, key: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table kept as ``key``, which is computed and kept if it isn't there."""
    name = f"cache-{key}"
    if name not in store.tables():
        store.create(name, compute())
    return store.read(name)


def fresh(entries: DataFrame, now: Column, seconds: float) -> DataFrame:
    """Entries that were created less than ``seconds`` before ``now``."""
    return entries.where(F.col("created") > now - F.make_dt_interval(secs=F.lit(float(seconds))))


def kept(entries: DataFrame, capacity: int, policy: str = "lru") -> DataFrame:
    """The ``capacity`` entries that a policy keeps, ties by key (the smaller stays)."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy: {policy!r}")
    return entries.orderBy(*[F.desc(c) for c in POLICIES[policy]], "key").limit(capacity)
