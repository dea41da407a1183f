import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import stats
from tessera.plans.ranks import ranked
from tessera.sources.store import with_score_ids


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_score_ids_with_other_columns(spark, adaptive):
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = spark.range(50_000).select((F.col("id") * 7919 % 50_000).alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("payload"), F.lit(1).alias("_part"))
        got = with_score_ids(rows, "k", after=10).select("k", "score_id", "payload", "_part").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])
    assert len(got) == 50_000 and all(r.score_id == r.k + 11 for r in got)


def test_places_in_groups_with_nulls_and_a_hot_group(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "b", "hot", "hot", "hot"]), rng.choice([None, 1, 2, 3]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, i int")
    got = {r.i: (r["_place"], r.n) for r in ranked(df, ["g"], ["v", "i"], total="n").collect()}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in own] == [(k, len(own)) for k in range(1, len(own) + 1)]
    assert ranked(df.limit(0), ["g"], ["v"]).count() == 0


def test_percentiles_are_interpolated(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 10.0), ("b", 5.0), ("b", None), (None, 7.0)], "g string, v double")
    got = {r.g: (r.p50, r.p90) for r in stats.percentiles(df, "v", ["g"], {"p50": 0.5, "p90": 0.9}).collect()}
    assert got == {"a": (2.0, pytest.approx(8.4)), "b": (5.0, 5.0), None: (7.0, 7.0)}
