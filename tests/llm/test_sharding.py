import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import sharding


def brute_shard(key: int, shards: int) -> int:
    """Equal weights: the shard with the largest uniform number, as -ln(u) falls with u."""

    def u(i):
        h = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
        # Spark hashes a 32-bit number as its four bytes, seeded with the hash so far.
        return xxhash.xxh64_intdigest(i.to_bytes(4, "little", signed=True), h) >> 11

    return max(range(shards), key=lambda i: (u(i), -i))


def test_query_over_the_whole_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = sharding.op1_shards(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    slots = {}
    for r in got:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert (r.shard, r.grown_shard) == (brute_shard(r.doc_id, 24), brute_shard(r.doc_id, 25))
        assert r.grown_shard in (r.shard, 24)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(r.grown_shard == 24 for r in got) < len(docs) / 8


def test_weights_and_moves(spark):
    keys = spark.range(20_000)
    share = lambda w: Counter(r[0] for r in keys.select(sharding.rendezvous(F.col("id"), w)).collect())
    n = share([1.0, 2.0, 0.0, 1.0])
    assert set(n) == {0, 1, 3} and abs(n[1] - 10_000) < 500 and abs(n[0] - 5_000) < 400
    both = keys.select(sharding.rendezvous(F.col("id"), [1.0, 2.0, 1.0]).alias("a"), sharding.rendezvous(F.col("id"), [1.0, 3.0, 1.0]).alias("b"))
    assert all(r.a == r.b or r.b == 1 for r in both.collect())
    for weights in ([0.0], [], [1.0, -1.0], [1.0, float("nan")], [float("inf")]):
        with pytest.raises(ValueError):
            sharding.rendezvous(F.col("id"), weights)


def test_columns_named_as_the_new_ones(spark):
    df = spark.createDataFrame([(i, "x", "y", i) for i in range(50)], "k long, Shard string, slot string, a_b long")
    got = sharding.shard(df, "k", [1.0, 1.0], tie_cols=("a_b",))
    assert got.columns == ["k", "a_b", "shard", "slot"]
    assert sorted(r.k for r in got.select("k", "shard", "slot").collect() if r.shard in (0, 1) and r.slot < 50) == list(range(50))


def test_odd_rows(spark):
    rows = [(None, "a", 1), (None, "a", 1), (5, "b", 2), (5, "c", 2), (5, "b", 2)]
    df = spark.createDataFrame(rows, "k long, _shard string, slots int")
    got = sharding.shard(df, "k", [1.0, 1.0], tie_cols=("_shard",)).collect()
    assert Counter((r.k, r._shard, r.slots) for r in got) == Counter(rows)
    assert len({r.shard for r in got if r.k == 5}) == 1
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard(df.limit(0), "k", [1.0]).count() == 0
