"""Versioned rows, ranges, hash rings and wait graphs as queries over tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.bits import ranges_overlap
from tessera.plans.durable import durable

#: Places on a ring, at most: some 20 MB that go to the tasks.
MOST_PLACES = 1_000_000

LEVELS = ("read_uncommitted", "read_committed", "repeatable_read", "serializable")


def visible(level: str, snapshot: Column, own: Column | None = None, begin: str = "begin_ts", end: str = "end_ts", committed: str = "committed", tx: str = "tx_id") -> Column:
    """Whether a version can be seen at a time; ``end`` 0 or null: it still stands.

    Uncommitted reads see every version that stands. Others see committed versions (and their own):
    the newest ones under ``read_committed``, those of the time ``snapshot`` above that.
    """
    if level not in LEVELS:
        raise ValueError(f"unknown isolation level: {level!r}")
    b, e = F.col(begin), F.coalesce(F.col(end), F.lit(0))
    if level == "read_uncommitted":
        return e == 0
    mine = F.lit(False) if own is None else F.col(tx) == own
    if level == "read_committed":
        return (F.col(committed) | mine) & (e == 0)
    return mine & (e == 0) | F.col(committed) & (b <= snapshot) & ((e == 0) | (e > snapshot))


def as_of(rows: DataFrame, key: str, when: Column, begin: str = "begin_ts") -> DataFrame:
    """Of each key, the newest row that began at ``when`` or before: an aggregation, no window."""
    rest = [c for c in rows.columns if c != key]
    return rows.where(F.col(begin) <= when).groupBy(key).agg(F.max_by(F.struct(*rest), begin).alias("_r")).select(key, "_r.*")


def range_scan(rows: DataFrame, key: str, low, high) -> DataFrame:
    """Rows with a key from ``low`` to ``high``, both included; pushed down to the scan."""
    return rows.where(F.col(key).between(low, high))


def ring(nodes: DataFrame, node: str = "node", replicas: int = 3) -> DataFrame:
    """``node`` and ``point`` (0 to 2**32 - 1): the places of each node on the ring."""
    copies = nodes.select(F.col(node).alias("node"), F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))).alias("copy"))
    return copies.select("node", point(F.concat_ws("#", "node", "copy")).alias("point"))


def point(key: Column) -> Column:
    """A key's place on the ring: the first 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def on_ring(keys: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """``keys`` with ``node``: the first place at or after the key's, or else the first of all.

    The ring is a table of nodes times replicas, ``MOST_PLACES`` at most, which goes to the tasks as a
    sorted array; each key is then a binary search in it, without a join.
    """
    rows = places.orderBy("point", "node").limit(MOST_PLACES + 1).collect()
    if not rows:
        raise ValueError("the ring has no nodes")
    if len(rows) > MOST_PLACES:
        raise ValueError(f"the ring has more than {MOST_PLACES} places")
    points, nodes = np.array([r["point"] for r in rows]), np.array([r["node"] for r in rows], object)

    @F.pandas_udf(places.schema["node"].dataType.simpleString())
    def found(at: pd.Series) -> pd.Series:
        return pd.Series(nodes[np.searchsorted(points, at.to_numpy()) % len(points)])

    return keys.withColumn("node", found(F.coalesce(point(F.col(key)), F.lit(0))))


def _only_cycles(edges: DataFrame) -> DataFrame:
    """Edges without those whose ends nobody waits for or that wait for nobody, again and again."""
    now = durable(edges.select("waiter", "holder").distinct())
    n = now.count()
    while n:
        left = now.join(now.select(F.col("waiter").alias("holder")).distinct(), "holder", "left_semi")
        left = durable(left.join(now.select(F.col("holder").alias("waiter")).distinct(), "waiter", "left_semi").select("waiter", "holder"))
        m = left.count()
        if m == n:
            break
        now, n = left, m
    return now


def waits(edges: DataFrame) -> DataFrame:
    """``waiter`` and ``holder``: everything that each transaction waits for, directly or not.

    Paths of twice the length are joined in each round, so rounds are logarithmic in the longest path.
    """
    now = durable(edges.select("waiter", "holder").distinct())
    n = now.count()
    while True:
        step = now.select(F.col("waiter").alias("holder"), F.col("holder").alias("next"))
        now = durable(now.unionByName(now.join(step, "holder").select("waiter", F.col("next").alias("holder"))).distinct())
        m = now.count()
        if m == n:
            return now
        n = m


def _spread(marks: DataFrame, edges: DataFrame) -> DataFrame:
    """``node``, ``mark``: the largest mark that reaches each marked node along ``edges`` (``source``, ``target``)."""
    now = durable(marks)
    while True:
        sent = now.join(edges, now["node"] == edges["source"]).select(F.col("target").alias("node"), "mark")
        step = durable(now.unionByName(sent).groupBy("node").agg(F.max("mark").alias("mark")))
        changed = step.join(now, ["node", "mark"], "left_anti").limit(1).count()
        now = step
        if not changed:
            return now


def deadlocked(edges: DataFrame) -> DataFrame:
    """``tx``: the transactions that wait for themselves, directly or not.

    The largest id that reaches a transaction is its mark; those that reach the transaction of their
    own mark by others of that mark wait for each other. They are taken out, and the rest is marked anew.
    What is stored grows with the edges, not with the pairs that reach each other.
    """
    left = _only_cycles(edges)
    out = left.select(F.col("waiter").alias("tx")).limit(0)
    while left.limit(1).count():
        nodes = left.select(F.col("waiter").alias("node")).union(left.select("holder")).distinct()
        marks = _spread(nodes.withColumn("mark", F.col("node")), left.select(F.col("waiter").alias("source"), F.col("holder").alias("target")))
        of = marks.select(F.col("node").alias("waiter"), F.col("mark").alias("own")), marks.select(F.col("node").alias("holder"), F.col("mark").alias("other"))
        inner = durable(left.join(of[0], "waiter").join(of[1], "holder").where("own = other").select("waiter", "holder"))
        back = inner.select(F.col("holder").alias("source"), F.col("waiter").alias("target"))
        ring = _spread(marks.where("node = mark"), back).select("node")
        within = inner.join(ring.withColumnRenamed("node", "waiter"), "waiter", "left_semi").join(ring.withColumnRenamed("node", "holder"), "holder", "left_semi")
        out = durable(out.unionByName(within.select(F.col("waiter").alias("tx"))).distinct())
        rest = inner.join(ring.withColumnRenamed("node", "waiter"), "waiter", "left_anti").join(ring.withColumnRenamed("node", "holder"), "holder", "left_anti")
        left = _only_cycles(rest)
    return out


def modulo_shard(key: Column, shards: int) -> Column:
    """The key modulo the number of shards, from 0."""
    return F.pmod(key, F.lit(shards))


def hash_shard(key: Column, shards: int) -> Column:
    """The first 32 bits of the key's MD5 modulo the number of shards."""
    return F.pmod(point(key), F.lit(shards)).cast("int")


def sharing_views(views: DataFrame, tx: str = "tx", active: str = "active") -> DataFrame:
    """``tx``: transactions whose view holds an active transaction that another's view holds as well."""
    seen = views.select(tx, active).distinct()
    shared = seen.groupBy(active).agg(F.count("*").alias("_n")).where("_n > 1").select(active)
    return seen.join(shared, active, "left_semi").select(tx).distinct()


def lock_conflicts(locks: DataFrame, width: int) -> DataFrame:
    """``a``, ``b`` (a < b): transactions with locks on closed ranges (``low``, ``high``) that share a key, not both ``shared``.

    Ranges meet in the bins of ``width`` keys that they touch, at the first bin that two share.
    """
    bin_ = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    binned = locks.select("tx", "low", "high", "shared", F.explode(F.sequence(bin_("low"), bin_("high"))).alias("bin"))
    a = binned.select("bin", *[F.col(c).alias(f"a_{c}") for c in ("tx", "low", "high", "shared")])
    b = binned.select("bin", *[F.col(c).alias(f"b_{c}") for c in ("tx", "low", "high", "shared")])
    first = F.col("bin") == F.floor(F.greatest("a_low", "b_low") / F.lit(width))
    met = ranges_overlap(F.col("a_low"), F.col("a_high"), F.col("b_low"), F.col("b_high")) & first
    both = a.join(b, "bin").where((F.col("a_tx") < F.col("b_tx")) & ~(F.col("a_shared") & F.col("b_shared")) & met)
    return both.select(F.col("a_tx").alias("a"), F.col("b_tx").alias("b")).distinct()
