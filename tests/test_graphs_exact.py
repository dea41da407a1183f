"""Graph queries against their SQL on tables where walks alone miss neighbours."""

import duckdb
import numpy as np
import pytest

from tessera.operators import hnsw
from tessera.plans import catalogue


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """350 copies of each of two vectors: their nodes link to their own kind only."""
    path = str(tmp_path_factory.mktemp("copies"))
    x = np.random.default_rng(1).normal(size=(2, 64))
    rows = [(i, x[i // 350].tolist(), i % 10) for i in range(700)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", ["hnsw_deleted", "hnsw_filtered", "hnsw_search", "ivf_hnsw_search"])
def test_nothing_is_missed(spark, copies, name):
    got = catalogue.queries()[name](spark, copies).select("query_id", "vec_id", "rank", "distance").collect()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{copies}/embeddings.parquet/*.parquet')")
    want = c.execute(f"SELECT query_id, vec_id, rank, distance FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_deletion_keeps_the_shards(spark, monkeypatch):
    """500 vectors make five shards of 130 nodes at most, the 428 that stay would make four."""
    monkeypatch.setattr(hnsw, "MOST_NODES", 130)
    x = np.random.default_rng(2).normal(size=(500, 12))
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    left, shards = e.where("id % 7 <> 0"), hnsw.shards_of(e)
    assert shards == hnsw.shards_of(left) + 1
    edges = hnsw.without_nodes(hnsw.build(e, links=8, beam=40, shards=shards), e.where("id % 7 = 0"), 8)
    queries = [(i, x[i].tolist()) for i in range(0, 500, 20)]
    got = hnsw.batch(left, edges, queries, 10, beam=10, links=8, exact=True, shards=shards).orderBy("query_id", "rank").collect()
    ids = np.array([i for i in range(500) if i % 7])
    for i, _ in queries:
        d = np.sqrt(((x[ids] - x[i]) ** 2).sum(axis=1))
        assert [r.id for r in got if r.query_id == i] == ids[np.lexsort((ids, np.round(d, 9)))][:10].tolist()
    with pytest.raises(Exception, match="not in this shard"):
        hnsw.batch(left, edges, queries, 10, links=8).collect()


def test_checks_in_tiles(monkeypatch):
    """Walks that found all, fewer than k or none; allowed nodes fewer than k; a tile smaller than the queries."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 5))
    x[40:60] = x[3]
    ids = rng.permutation(1000)[:90]
    ids.sort()
    g, q = hnsw.grown(ids, x, 4, 8), x[[3, 10, 50, 80]]
    monkeypatch.setattr(hnsw, "CHECK_PAIRS", 100)
    for ok in (None, np.arange(90) % 2 == 0, np.arange(90) < 4, np.zeros(90, bool)):
        may = np.arange(90) if ok is None else np.nonzero(ok)[0]
        want = [may[np.lexsort((ids[may], np.round(np.sqrt(((x[may] - v) ** 2).sum(axis=1)), 9)))][:7].tolist() for v in q]
        for walked in ([g.search(v, 7, 7, ok) for v in q], [[] for _ in q]):
            assert [[n for _, n in near] for near in g.checked(q, walked, 7, ok)] == want
