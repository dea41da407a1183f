import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.plans import catalogue


@pytest.mark.parametrize("name", ["lsh_batch_topk", "pq_batch_topk", "ivf_quality"])
@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_recall_against_brute_force(spark, name, size):
    rows = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    true = {int(ids[i]): set(ids[np.lexsort((ids, -(x @ x[i])))[:10]].tolist()) for i in np.nonzero(ids % 20 == 0)[0]}
    got = catalogue.queries()[name](spark, f"/root/testdata/{size}")
    if name == "ivf_quality":
        n, recall = got.agg(F.count("*"), F.avg("recall")).first()
    else:
        found = {}
        for r in got.collect():
            found.setdefault(r.query_id, set()).add(r.vec_id)
        n, recall = len(found), np.mean([len(found[q] & t) / 10 for q, t in true.items()])
    print(name, size, round(float(recall), 4))
    assert n == len(true) and recall >= 0.9
