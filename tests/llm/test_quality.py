import zlib

import numpy as np
import pyarrow as pa

from tessera.llm import quality as q


def test_statistics():
    x = q.statistics(pa.array([None, "", "A plain line, of words.", "LOUD!! WORDS!! ÉTÉ!!", "a a a a", "x | y | z", "KEY9"]))
    assert x.shape == (7, 5) and not x[:3].any() and not x[6, 0]
    assert x[3, 0] > 0.8 and x[3, 1] > 0 and x[4, 3] == 1 and abs(x[4, 4] - 0.75**0.5) < 1e-12 and x[5, 2] > 0


def test_densities_against_numpy():
    rng = np.random.default_rng(2)
    x = [rng.normal(k, 1 + k, (300, 5)) for k in (0, 1)]
    x[0][:, 3] = 0  # constant in one class
    classes = q.discriminant(np.array([300.0, 300.0]), np.array([a.sum(0) for a in x]), np.array([a.T @ a for a in x]))
    cov = [np.cov(a.T) for a in x]
    pooled = (cov[0] + cov[1]) * 299 / 598
    for g, c in zip(classes, cov, strict=True):
        m = (1 - q.TO_POOLED) * c + q.TO_POOLED * pooled
        m = (1 - q.TO_IDENTITY) * m + q.TO_IDENTITY * np.trace(m) / 5 * np.eye(5)
        assert np.allclose(g.whiten.T @ g.whiten, np.linalg.inv(m))
        assert np.isclose(g.constant, np.log(0.5) - 0.5 * np.linalg.slogdet(m)[1])
    assert q.discriminant(np.array([0.0, 3.0]), np.zeros((2, 5)), np.zeros((2, 5, 5))) is None


def test_held_out_rows_are_told_apart_and_not_learnt_from(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in q.quality_scores(docs, labels).collect()}
    assert len(got) == docs.count()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    assert all(r.held_out == held(i) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    truth = {r.doc_id: r.quality for r in labels.collect()}
    tested = [(got[i].predicted, y) for i, y in truth.items() if i in got and held(i)]
    assert np.mean([a == b for a, b in tested]) > 0.97 and len(tested) > 40
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(q.is_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in q.quality_scores(docs, flipped).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (2, "Fine words.", 3)], "doc_id long, text string, score int")
    none = spark.createDataFrame([(2, 1, None), (1, None, 0), (1, 7, 0)], "doc_id long, quality int, toxic int")
    got = q.quality_scores(docs, none).collect()
    assert len(got) == 4 and all(r.score == 0.5 and r.predicted == 1 for r in got)
    assert q.quality_scores(docs.limit(0), none).count() == 0
