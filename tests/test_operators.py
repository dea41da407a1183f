import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, hybrid, ivf, kmeans, knn, lsh, pca, postings, pq, quality, rag, stats, versions, weights
from tessera.plans import selector
from tessera.plans.components import components

AXES = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0]), (4, [0.5, 0.5, 0.0])]


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "id long, vec array<double>" + extra)


def ids(df):
    return [r["id"] for r in df.collect()]


@pytest.fixture(scope="module")
def some(spark):
    rng = np.random.default_rng(8)
    return [(i, rng.normal(size=8).tolist()) for i in range(200)]


def test_nearest(spark):
    e = frame(spark, AXES)
    top = knn.nearest(e, [1, 0, 0], 2).collect()
    assert [r["id"] for r in top] == [1, 4] and top[0]["similarity"] >= 0.9
    for bad in (0, -1):
        with pytest.raises(ValueError):
            knn.nearest(e, [1, 0, 0], bad)
    assert ids(knn.nearest(frame(spark, [*AXES, (5, [1.0]), (6, None)]), [1, 0, 0], 9)) == [1, 4, 2, 3]
    assert ids(knn.nearest(e.limit(0), [1, 0, 0], 2)) == []


def test_ties_go_by_id(spark):
    line = frame(spark, [(i, [float(i), 2.0 * i, 3.0 * i]) for i in range(1, 100)])
    top = knn.nearest(line.withColumn("vec", F.col("vec")), [50, 100, 150], 99).collect()
    assert all(abs(r["similarity"] - 1) < 1e-12 for r in top)
    assert ids(knn.nearest(line, [50, 100, 150], 1, "l2")) == [50]


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2", "l1"])
def test_batch_equals_single(spark, some, metric):
    e = frame(spark, [*some, (900, None), (901, [1.0])])
    queries = [(i, v) for i, v in some[:3]]
    got = {}
    for r in knn.batch(e, queries, 5, metric).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    for i, v in queries:
        assert [got[i][k] for k in range(1, 6)] == ids(knn.nearest(e, v, 5, metric))
    assert knn.batch(e, [], 5).count() == 0


def test_filters_and_stages(spark, some):
    e = frame(spark, some).withColumn("odd", F.col("id") % 2 == 1)
    q = some[0][1]
    every = ids(knn.nearest(e, q, 200))
    assert ids(knn.nearest_where(e, q, 5, F.col("odd"))) == [i for i in every if i % 2][:5]
    assert ids(knn.nearest_where(e, q, 5, F.col("odd"), first=False)) == [i for i in every[:10] if i % 2][:5]
    assert ids(knn.two_stage(e, q, 5, 200)) == every[:5]
    assert all(r["similarity"] >= 0.3 for r in knn.nearest_above(e, q, 0.3, 50).collect())
    assert ids(knn.two_stage(frame(spark, AXES), [1, 0, 0], 2, 3, threshold=0.5)) == [1, 4]


def test_full_probe_is_exact(spark, some):
    e = frame(spark, some)
    c = kmeans.fit(e, 6)
    cells = ivf.assigned(e, list(range(6)), c)
    assert cells.count() == 200
    q = some[7][1]
    assert ids(ivf.search(cells, q, 10, ivf.probes(q, list(range(6)), c, 6))) == ids(knn.nearest(e, q, 10))
    assert ivf.probes(q, list(range(6)), c, 0)[0] == cells.where("id = 7").first()["cid"]
    with pytest.raises(ValueError):
        kmeans.fit(e.limit(2), 6)


def test_cluster_metrics(spark):
    blobs = frame(spark, [(1, [1.0, 1.0]), (2, [1.0, 3.0]), (3, [9.0, 9.0])])
    cells = ivf.assigned(blobs, [0, 1, 2], np.array([[1.0, 2.0], [9.0, 9.0], [50.0, 50.0]]))
    every = spark.createDataFrame([(0,), (1,), (2,)], "cid long")
    got = {r["cid"]: (r["n"], r["variance"], r["radius"], r["density"]) for r in ivf.metrics(cells, every).collect()}
    assert got == {0: (2, 1.0, 1.0, 1.0), 1: (1, 0.0, 0.0, 1.0), 2: (0, 0.0, 0.0, 0.0)}
    assert ivf.needs_rebuild(cells, 2, 9) and not ivf.needs_rebuild(cells, 1, 2)
    m = ivf.metrics(cells, every)
    centroids = spark.createDataFrame([(0, [1.0, 2.0]), (1, [9.0, 9.0]), (2, [50.0, 50.0])], "cid long, c array<double>")
    assert [r["cid"] for r in ivf.candidate_cells(m, centroids, [8.0, 8.0], 2, 2).collect()] == [1, 0]


def test_probe_counts():
    assert ivf.adaptive_nprobe_by_balance([], 4, 10) == 1
    assert ivf.adaptive_nprobe_by_balance([1] * 50 + [100], 10, 1000) == 8
    assert ivf.adaptive_nprobe_by_balance([9] * 50, 10, 10, queried=True) == 23
    assert [ivf.adaptive_nprobe_by_size(n, 12) for n in (10, 20_000, 200_000, 2_000_000)] == [3, 4, 6, 8]
    assert [ivf.static_nprobe(n, 100) for n in (10, 200_000, 2_000_000)] == [2, 5, 10]


def test_product_quantization(spark, some):
    e = frame(spark, some)
    book = pq.train(e, 4, 16)
    codes = pq.encoded(e, book)
    assert codes.count() == 200 and all(len(r["codes"]) == 4 and max(r["codes"]) < 16 for r in codes.collect())
    q = some[3][1]
    r = pq.with_distance(codes, q, book).where("id = 5").first()
    back = pq.decoded(codes, book).where("id = 5").first()["vec"]
    assert r["distance"] == pytest.approx(sum((a - b) ** 2 for a, b in zip(q, back, strict=True)))
    whole = pq.from_vectors([v for _, v in some], 4)
    assert pq.decoded(pq.encoded(e, whole), whole).where("id = 5").first()["vec"] == pytest.approx(some[5][1])
    assert pq.lloyd_codebook(e, 2, 4, 2).shape == (2, 4, 4)
    with pytest.raises(ValueError):
        pq.train(e, 3, 4)
    with pytest.raises(ValueError):
        pq.encoded(e, np.zeros((4, 300, 2)))


def test_hashing_search(spark, some):
    from tessera.functions import lsh as H

    e, normals = frame(spark, some), H.planes(6, 4, 8)
    index = lsh.index(e, normals)
    assert index.count() == 200 * 6
    q = some[11][1]
    assert 11 in ids(lsh.candidates(index, lsh.query_probes(spark, q, normals)))
    wide = set(ids(lsh.candidates(index, lsh.query_probes(spark, q, normals, 4))))
    assert set(ids(lsh.candidates(index, lsh.query_probes(spark, q, normals)))) <= wide
    assert ids(lsh.search(e, index, q, normals, 1)) == [11]
    assert ids(lsh.search(e, index.limit(0), q, normals, 3)) == ids(knn.nearest(e, q, 3))


def test_graph(spark, some, monkeypatch):
    e = frame(spark, some[:60])
    monkeypatch.setattr(knn, "VECTOR_BLOCK", 25)
    edges = graph.build(e, 4)
    x = np.array([v for _, v in some[:60]])
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(60) for j in np.argsort(d[i])[:4]}
    assert {(r["src"], r["dst"]) for r in edges.collect()} == want
    left = graph.without_nodes(edges, spark.createDataFrame([(0,), (1,)], "id long")).collect()
    assert {(r["src"], r["dst"]) for r in left} == {(a, b) for a, b in want if not {a, b} & {0, 1}}
    assert graph.hnsw_settings(5) == (16, 100, 50) and graph.hnsw_settings(10**8) == (128, 800, 400)
    assert graph.adaptive_settings(10**6, 700) == (64, 800) and graph.adaptive_settings(5, 8) == (16, 100)


def test_pca(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3)) * [5, 1, 0.1]
    e = frame(spark, [(i, v) for i, v in enumerate(x.tolist())])
    c = pca.fit(e, target=2)
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert c.variances == pytest.approx(want[:2])
    assert pca.fit(e, ratio=0.9).rows.shape == (1, 3) and pca.fit(e).rows.shape == (3, 3)
    got = pca.applied(e, c).where("id = 4").first()["reduced"]
    assert got == pytest.approx((c.rows @ (x[4] - x.mean(0))).tolist())


def test_boolean_search(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "a c", "b"), (3, "B", None), (None, "a", "a"), (4, None, None)], "doc_id long, text string, title string")
    p = postings.build(docs, {"text": "body", "title": "title"}, bits=F.col("doc_id"))
    a, b, c, no = (postings.Term("body", w) for w in ("a", "b", "c", "zz"))
    find = lambda q, *m: sorted(r["doc_id"] for r in postings.search(p, q, *m).collect())
    assert find(a) == [1, 2] and find(a.also(b)) == [1] and find(b.either(c)) == [1, 2, 3] and find(a.also(no)) == []
    assert find(a.also(b.either(c))) == [1, 2] and find(postings.Term()) == [] and find(b.either(c), 2) == [2, 3] and find(b.either(c), 0, 1) == [2] and find(a, 0, 0, (2,)) == [2]
    assert find(postings.Term("title", "b")) == [2]
    assert str(a.also(b.either(c))) == "(body\u0001a&(body\u0001b|body\u0001c))" and a.also(postings.Term()) == a
    assert {r["doc_id"]: r["n_hits"] for r in postings.hits(p, ["a", "b"]).collect()} == {1: 2, 2: 2, 3: 1}
    lists = [p.where(F.col("word") == w).select("doc_id") for w in ("a", "c")]
    assert sorted(r[0] for r in postings.intersection(lists).collect()) == [1, 2]
    assert sorted(r[0] for r in postings.union(lists).collect()) == [1, 2]


def test_merges(spark):
    v = spark.createDataFrame([(1, 0.1), (2, 0.2)], "id long, distance double")
    s, none = spark.createDataFrame([(2,), (3,), (3,)], "id long"), spark.createDataFrame([], "id long")
    got = lambda k, a=v, b=s: sorted((r["id"], round(r["distance"], 6)) for r in hybrid.merge(a, b, k).collect())
    assert got("intersection") == got("nonsense") == [(2, 0.2)]
    assert got("union") == [(1, 0.1), (2, 0.2), (3, 1.0)]
    assert got("weighted") == [(1, 0.07), (2, 0.17), (3, 0.3)]
    assert got("vector_first") == [(1, 0.1), (2, 0.2)] and got("vector_first", v.limit(0)) == [(2, 1.0), (3, 1.0)]
    assert got("scalar_first") == [(2, 0.0), (3, 0.0)] and got("scalar_first", v, none) == [(1, 0.1), (2, 0.2)]
    assert got("intersection", v, none) == []
    assert [r["id"] for r in hybrid.with_fallback(v, s).collect()] == [2]
    assert sorted(r["id"] for r in hybrid.with_fallback(v.where("id = 1"), s).collect()) == [2, 3]
    assert [tuple(r) for r in hybrid.top_of_shards(v.unionByName(v.withColumn("distance", F.col("distance") * 2)), 1).collect()] == [(1, 0.1)]


def test_builder(spark):
    rows = frame(spark, [(i, [float(i), 1.0], None if i == 3 else i % 2) for i in range(6)], ", tag long")
    q = hybrid.Query()
    assert ids(q.where("tag", "eq", 1).run(rows)) == [1, 5]
    assert ids(q.where("tag", "eq", 1).either("id", "lt", 1).run(rows)) == [0, 1, 5]
    assert ids(q.order_by("tag", descending=True).limit(3).run(rows)) == [3, 1, 5]
    assert ids(q.order_by("tag").offset(4).run(rows)) == [5, 3]
    assert ids(q.near([5, 1], 3, "l2").run(rows)) == [5, 4, 3]
    assert ids(q.near([5, 1], 3, "l2").unless("tag", "eq", 0).run(rows)) == [5]
    assert ids(q.near([5, 1], 1, "l2").where("id", "in", [0]).merged_by("union").run(rows)) == [5, 0]
    with pytest.raises(ValueError):
        q.where("tag", "near", 1)


def test_quality(spark):
    found = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 9, 1)], "query_id long, id long, rank int")
    truth = spark.createDataFrame([(1, 11), (1, 12), (1, 99), (3, 5)], "query_id long, id long")
    m = {r["query_id"]: r for r in quality.metrics(found, truth).collect()}
    dcg, ideal = 1 / np.log2(3) + 1 / np.log2(4), sum(1 / np.log2(i + 1) for i in (1, 2, 3))
    assert (m[1]["recall"], m[1]["precision"], m[1]["f1"], m[1]["mrr"]) == pytest.approx((2 / 3, 2 / 3, 2 / 3, 0.5)) and m[1]["ndcg"] == pytest.approx(dcg / ideal)
    assert tuple(m[2])[1:] == tuple(m[3])[1:] == (0, 0, 0, 0, 0)


def test_statistics(spark):
    rows = spark.createDataFrame([(1, i, float(i)) for i in range(1, 12)] + [(1, 12, 500.0), (2, 1, 7.0)], "k long, t long, v double")
    p = stats.percentiles(rows.where("k = 1"), "v").first()
    assert p["p50"] == 6.5
    assert [r["v"] for r in stats.anomalies(rows, "v", ["k"]).collect()] == [500.0] == [r["v"] for r in stats.anomalies(rows.where("k = 1"), "v").collect()]
    e = {r["k"]: r["average"] for r in stats.moving_average(rows, ["k"], ["t"], "v").collect()}
    want = 1.0
    for x in [*map(float, range(2, 12)), 500.0]:
        want = 0.9 * want + 0.1 * x
    assert e[1] == pytest.approx(want) and e[2] == 7
    t = stats.trend(rows.withColumn("q", F.lit(1.0)), "k", ["t"], "v", "q").collect()
    assert [(r["k"], r["trend"]) for r in t] == [(1, "degrading")]
    assert rows.limit(0).agg(stats.mean("v").alias("m"), stats.deviation("v").alias("d")).first() == (0, 0)
    assert {r["low"]: r["n"] for r in stats.histogram(rows, "v", 10.0).collect()} == {0: 10, 10: 2, 500: 1}


def test_history_and_context(spark):
    m = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", "x" * 10 * (i + 1)) for i in range(4)], "conv_id long, turn long, role string, text string")
    assert sorted(r["turn"] for r in rag.last_turns(m, 2).collect()) == [2, 3]
    assert sorted(r["turn"] for r in rag.last_tokens(m, 40).collect()) == [2, 3] and rag.last_tokens(m, 19).count() == 0
    h = rag.history_text(m.where("turn < 2")).first()["history"]
    assert h == "用户：" + "x" * 10 + "\n助手：" + "x" * 20
    p = spark.range(1).select(rag.prompt(F.lit("ctx"), F.lit(""), F.lit("why")).alias("p")).first()["p"]
    assert p == "知识库内容：\nctx\n用户问题：why"
    found = spark.createDataFrame([(2, 0.1), (1, 0.3), (9, 0.2)], "id long, distance double")
    contents = spark.createDataFrame([(1, "one"), (2, "two")], "id long, content string")
    assert rag.context(found, contents).first()["context"] == "two\none"
    items = frame(spark, AXES).withColumn("confidence", F.lit(0.5)).withColumn("used_count", F.lit(2))
    assert ids(rag.knowledge(items, [1, 0, 0], 0.5)) == [1, 4]
    assert [(r["id"], r["used_count"]) for r in rag.memories(items, [1, 0, 0], 0.8).collect()] == [(1, 3)]


def test_versions_rings_and_waits(spark):
    v = spark.createDataFrame([("a", 1, 5, True, 0), ("a", 5, 0, True, 0), ("b", 3, 0, False, 7)], "k string, begin_ts long, end_ts long, committed boolean, tx_id long")
    see = lambda level, at, own=None: sorted((r["k"], r["begin_ts"]) for r in v.where(versions.visible(level, F.lit(at), own)).collect())
    assert see("read_uncommitted", 4) == [("a", 5), ("b", 3)] and see("read_committed", 4) == [("a", 5)]
    assert see("repeatable_read", 4) == [("a", 1)] and see("serializable", 5, F.lit(7)) == [("a", 5), ("b", 3)]
    with pytest.raises(ValueError):
        versions.visible("none", F.lit(1))
    ring = versions.ring(spark.createDataFrame([("n1",), ("n2",)], "node string"))
    keys = spark.range(200).withColumnRenamed("id", "k")
    before = {r["k"]: r["node"] for r in versions.on_ring(keys, ring, "k").collect()}
    more = versions.ring(spark.createDataFrame([("n1",), ("n2",), ("n3",)], "node string"))
    after = {r["k"]: r["node"] for r in versions.on_ring(keys, more, "k").collect()}
    assert all(after[k] in (before[k], "n3") for k in before) and set(before.values()) == {"n1", "n2"}
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 6), (1, 9)], "waiter long, holder long")
    assert sorted(r["tx"] for r in versions.deadlocked(edges).collect()) == [1, 2, 3]
    assert sorted(r["holder"] for r in versions.waits(edges).where("waiter = 4").collect()) == [1, 2, 3, 9]
    assert versions.deadlocked(edges.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 470)] + [(None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_embeddings_of_documents(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "z"), (3, None)], "doc_id long, text string")
    e = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 3.0])], "word string, vec array<double>")
    assert [(r["doc_id"], r["vec"]) for r in weights.mean_embedding(docs, e).collect()] == [(1, pytest.approx([2 / 3, 1.0]))]
    with pytest.raises(ValueError):
        weights.vocabulary(docs, 0)


def test_strategy_rules():
    S = selector.Situation
    assert selector.choose(S(10, 64)) == "brute_force" and selector.choose(S(10**6, 64)) == "brute_force"
    assert selector.choose(S(10**6, 512, ready=frozenset(["ivf_hnsw", "hnsw"]))) == "ivf_hnsw"
    assert selector.choose(S(20_000, 256, ready=frozenset(["enhanced_ivf"]))) == "enhanced_ivf"
    assert selector.choose(S(5_000, 4_000, ready=frozenset(["pq", "hnsw"]))) == "pq"
    assert selector.choose(S(5_000, 64, milliseconds=5, ready=frozenset(["enhanced_lsh"]))) == "enhanced_lsh"
    assert selector.choose(S(200_000, 64, wide=True)) == "hybrid"
    assert selector.hybrid_dispatch(10, 8, True) == "brute_force" and selector.hybrid_dispatch(5_000, 2_000, True) == "enhanced_lsh"
    assert selector.ivf_cells(5) == 100 and selector.pq_parts(600) == 16 and selector.health(frozenset(["pq"]))["pq"]
