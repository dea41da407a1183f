from tessera.operators import knn
from tessera.plans import catalogue


def test_every_twentieth_vector_is_a_query(spark, sf):
    ids = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    wanted = {i for i in ids if i % 20 == 0}
    for name, rows in (("knn_batch_topk", 10), ("cosine_matrix", len(ids)), ("search_quality_estimate", 1)):
        got = catalogue.queries()[name](spark, sf).select("query_id").collect()
        assert {r.query_id for r in got} == wanted and len(got) == rows * len(wanted)


def test_pairs_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn, "QUERY_BLOCK", 2)
    e = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)] + [(9, None)], "id long, vec array<double>")
    got = knn.pairs(e, [(i, [1.0, float(i)]) for i in range(3)], "l2").collect()
    assert sorted((r.query_id, r.id, r.distance) for r in got) == [(i, j, float(abs(i - j))) for i in range(3) for j in range(5)]
    assert knn.pairs(e, []).count() == 0
