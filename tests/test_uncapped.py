import numpy as np
from pyspark.sql import functions as F

from tessera.operators import knn
from tessera.plans import catalogue


def test_all_above_the_threshold(spark):
    e = spark.createDataFrame([(i, [1.0, i / 1000]) for i in range(200)] + [(500, [-1.0, 0.0])], "id long, vec array<double>")
    assert {r.id for r in knn.nearest_above(e, [1.0, 0.0], 0.9).collect()} == set(range(200))
    assert [r.id for r in knn.nearest_above(e, [1.0, 0.0], 0.9, 3).collect()] == [0, 1, 2]


def test_no_row_is_cut(spark):
    sf = "/root/testdata/sf0.01"
    q = catalogue.queries()
    e = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    first = next(np.array(v, float) for i, v in e if i == 0)
    near = {i for i, v in e if np.dot(v, first) / np.linalg.norm(v) / np.linalg.norm(first) >= 0.2}
    assert {r.vec_id for r in q["knn_threshold"](spark, sf).collect()} == near
    assert q["kw_count_rank"](spark, sf).count() > 50
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    got = q["sort_nulls"](spark, sf).collect()
    assert len(got) == orders.count() > 30
    want = orders.select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p")).collect()
    assert [tuple(r) for r in got] == sorted((tuple(r) for r in want), key=lambda r: (r[1] is not None, [-ord(c) for c in r[1] or ""], r[0]))

