"""The plans that searches and filters should have."""

from pyspark.sql import functions as F

from tessera.operators import ivf, knn, versions
from tessera.plans.skew import grouped
from tessera.sources.tables import table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_query_needs_no_shuffle_of_vectors(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    p = plan(knn.nearest(e, [0.1] * 64, 10))
    assert "TakeOrderedAndProject" in p and "Exchange" not in p and "Join" not in p


def test_filters_and_columns_reach_the_scan(spark, sf):
    p = plan(versions.range_scan(table(spark, sf, "orders"), "o_orderkey", 100, 900).select("o_orderkey", "o_totalprice"))
    assert "GreaterThanOrEqual(o_orderkey,100)" in p and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in p


def test_visited_cells_prune_partitions(spark, tmp_path):
    cells = spark.range(100).select("id", F.array(F.col("id").cast("double")).alias("vec"), (F.col("id") % 10).alias("cid"))
    cells.write.partitionBy("cid").parquet(str(tmp_path / "cells"))
    p = plan(ivf.search(spark.read.parquet(str(tmp_path / "cells")), [3.0], 5, [1, 2], "l2"))
    assert "PartitionFilters: [cid" in p


def test_groups_are_shuffled_again_for_a_join(spark):
    rows = spark.range(10).withColumn("k", F.col("id") % 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        own = grouped(rows, ["k"], F.count("*").alias("n"))
        p = plan(rows.join(own, "k"))
        assert sorted((r["k"], r["n"]) for r in own.collect()) == [(0, 4), (1, 3), (2, 3)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert p.count("Exchange hashpartitioning(k") == 2


def test_words_are_split_once_for_weights(spark, sf):
    from tessera.plans import catalogue

    df = catalogue.queries()["tfidf_corpus"](spark, sf)
    df.collect()
    p = plan(df).split("== Initial Plan ==")[0]
    assert p.count("FileScan") == 1 and p.count("split(") == 1 and "ReusedExchange" in p


def test_chunks_are_folded_once(spark, sf):
    from tessera.plans import catalogue

    p = plan(catalogue.queries()["chunk_text"](spark, sf))
    assert p.count("aggregate(") == 1


def test_a_hybrid_query_scans_once_and_joins_nothing(spark, sf):
    from tessera.plans import catalogue

    p = plan(catalogue.queries()["hybrid_builder"](spark, sf))
    assert p.count("FileScan") == 1 and "Join" not in p


def test_a_ring_is_searched_without_a_join(spark, sf):
    from tessera.plans import catalogue

    p = plan(catalogue.queries()["hash_ring"](spark, sf))
    assert "Join" not in p and "filter(" not in p
