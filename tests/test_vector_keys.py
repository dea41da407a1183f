import duckdb

from tessera.plans import catalogue


def test_keys_round_as_the_sql_does(spark, tmp_path):
    """Halves go to even, near halves to their own side; no number, no component and no vector have their keys, too."""
    v = [
        [1 / 128, -9 / 128, 0.5],
        [0.1234565, 1.0000005, 0.0000005, -0.0000015, -1e-9, -0.0],
        [123456789.0000005, 1e22, 3.4e38],
        [float("nan"), float("inf"), -float("inf")],
        [1.0, None, 2.0],
        [None],
        [],
        None,
    ]
    spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>").selectExpr("*", "0L AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalogue.queries()["vector_keys"](spark, str(tmp_path)).select("vec_id", "key").collect()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = c.execute(f"SELECT vec_id, key FROM ({catalogue.oracle_sql()['vector_keys']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
