import numpy as np
import pytest

from tessera.llm import exchange


def test_totals_survive_encoding():
    for totals in ([], [1, 2, 254], [255, 256, 1, 10**12, 0]):
        t = np.array(totals, np.int64)
        assert exchange.from_numbers(exchange.numbers(t), len(t)).tolist() == totals
        assert exchange.from_bits(exchange.bits(t), len(t)).tolist() == [x > 1 for x in totals]


@pytest.mark.parametrize("parts", [1, 2, 7, 1000, 10**7])
def test_slices_cover_all_keys_in_order(parts):
    keys = np.unique(np.random.default_rng(3).integers(0, 2**64, 500, dtype=np.uint64))
    keys = np.r_[np.uint64(0), keys, np.uint64(2**64 - 1)]
    part, start, end = exchange.slices(keys, parts)
    assert start[0] == 0 and end[-1] == len(keys) and start[1:] == end[:-1]
    assert part == sorted(set(part)) and 0 <= part[0] and part[-1] == parts - 1
    for p, a, b in zip(part, start, end, strict=True):
        assert all(int(k >> np.uint64(32)) * parts >> 32 == p for k in keys[a:b])
    assert exchange.slices(keys[:0], parts) == ([], [], [])


def test_a_missing_reply_is_an_error():
    empty = exchange.rows_table([], exchange._REPLY_FIELDS)
    assert exchange.totals_of(empty, 0, bool, exchange.from_bits, np.zeros(0, np.uint64), 4).tolist() == []
    with pytest.raises(RuntimeError):
        exchange.totals_of(empty, 0, bool, exchange.from_bits, np.array([5], np.uint64), 4)


def test_equal_rows_are_spread():
    order = np.r_[np.full(10_000, -7), np.arange(500)].astype(np.int64)
    bucket = exchange.dealt(order, 40)
    assert bucket.min() >= 0 and bucket.max() < 40 and np.bincount(bucket[:10_000], minlength=40).max() < 600
    assert (exchange.dealt(order, 40) == bucket).all() and exchange.dealt(order[:0], 3).tolist() == []
    assert set(exchange.dealt(order, 1)) == {0}


def test_bundles_hold_all_rows(spark):
    rows = [(None, None)] * 300 + [(1, "é x")] * 70 + [(i, f"text {i}" * (i % 7)) for i in range(200)] + [(None, "t")]
    df = spark.createDataFrame(rows, "k long, t string").repartition(3)
    bundles, n, kind = exchange.bucketed(df, "k", "t", 100)
    assert kind == "bigint" and n > 5
    out = bundles.groupBy("bucket").applyInArrow(lambda t: exchange.rows_of(t).set_column(1, "_text", exchange.rows_of(t)["_text"].cast("string")), "_id long, _text string")
    got = sorted(((r[0], r[1]) for r in out.collect()), key=repr)
    assert got == sorted(((a, b or "") for a, b in rows), key=repr)


def test_packed_keys_come_back():
    rng = np.random.default_rng(5)
    for keys in ([], [0], [2**64 - 1], [0, 2**64 - 1], [7, 8, 300], rng.integers(0, 2**64, 999, dtype=np.uint64)):
        k = np.unique(np.array(keys, np.uint64))
        assert exchange.unpack(exchange.pack(k)).tolist() == k.tolist()
