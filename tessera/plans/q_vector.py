"""Queries over ``embeddings``: exact search, vector functions, indexes and their quality."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import lsh as H
from tessera.functions import vectors as V
from tessera.operators import graph, ivf, kmeans, knn, lsh, pca, pq, quality
from tessera.plans.catalogue import query
from tessera.sources.tables import table

#: Neighbours asked for, and the id of the vector that serves as the one query.
K, QUERY = 10, 0
_E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_Q = "q AS (SELECT v AS q FROM e WHERE vec_id = 0)"
_COS = "list_cosine_similarity(v, q)"
_D2 = "list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - {c}[i]) * (v[i] - {c}[i])))"


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vec")
    )


def vector(rows: DataFrame, id_: int = QUERY) -> list[float]:
    """The one vector with an id, as a list."""
    return list(rows.where(F.col("id") == id_).first()["vec"])


def _top(found: DataFrame, *more) -> DataFrame:
    return found.select(F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"), *more)


def _register_knn(metric: str, sql: str) -> None:
    @query(f"knn_{metric}", f"WITH {_E}, {_Q} SELECT vec_id, round({sql}, 6) AS distance FROM e, q ORDER BY {sql}, vec_id LIMIT {K}")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = embeddings(spark, sf_dir)
        return _top(knn.nearest(e, vector(e), K, metric))


_register_knn("cosine", f"1 - {_COS}")
_register_knn("l2", "list_distance(v, q)")
_register_knn("l1", "list_sum(list_transform(range(1, len(v) + 1), lambda i: abs(v[i] - q[i])))")
_register_knn("dot", "-list_inner_product(v, q)")


@query(
    "vec_normalize",
    f"""WITH {_E}, s AS (SELECT vec_id, list_transform(v, lambda x: x * (label + 1)) AS v FROM e),
    n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM s)
    SELECT vec_id, round(n, 6) AS norm, round(v[1] / n, 6) AS first, round(list_sum(v) / n, 6) AS total FROM n""",
)
def vec_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir).withColumn("vec", F.transform("vec", lambda x: x * (F.col("label") + 1)))
    unit = e.withColumn("unit", V.normalize(F.col("vec")))
    total = F.aggregate("unit", F.lit(0.0), lambda s, x: s + x)
    return unit.select(F.col("id").alias("vec_id"), F.round(V.norm(F.col("vec")), 6).alias("norm"), F.round(F.get("unit", 0), 6).alias("first"), F.round(total, 6).alias("total"))


@query(
    "vec_norm_filter",
    f"""WITH {_E}, s AS (SELECT vec_id, list_transform(v, lambda x: x * label) AS v FROM e)
    SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM s
    WHERE sqrt(list_inner_product(v, v)) BETWEEN 2.5 AND 6.5""",
)
def vec_norm_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir).withColumn("vec", F.transform("vec", lambda x: x * F.col("label")))
    return e.where(V.within_norms(F.col("vec"), 2.5, 6.5)).select(F.col("id").alias("vec_id"), F.round(V.norm(F.col("vec")), 6).alias("norm"))


@query(
    "vec_range",
    f"WITH {_E} SELECT round(min(list_min(v)), 9) AS low, round(max(list_max(v)), 9) AS high, count(*) AS n FROM e",
)
def vec_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).agg(
        F.round(F.min(F.array_min("vec")), 9).alias("low"), F.round(F.max(F.array_max("vec")), 9).alias("high"), F.count("*").alias("n")
    )


@query(
    "vec_quantize8",
    f"""WITH {_E}, r AS (SELECT min(list_min(v)) AS lo, max(list_max(v)) AS hi FROM e),
    z AS (SELECT vec_id, v, list_transform(v, lambda x: lo + floor((x - lo) / (hi - lo) * 255.0 + 0.5) * ((hi - lo) / 255.0)) AS w FROM e, r)
    SELECT vec_id, round(list_sum(w), 6) AS total, round(list_distance(v, w), 6) AS error FROM z""",
)
def vec_quantize8(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    low, high = e.agg(F.min(F.array_min("vec")), F.max(F.array_max("vec"))).first()
    z = e.withColumn("w", V.quantize(F.col("vec"), F.lit(low), F.lit(high), 8))
    total = F.aggregate("w", F.lit(0.0), lambda s, x: s + x)
    return z.select(F.col("id").alias("vec_id"), F.round(total, 6).alias("total"), F.round(V.l2(F.col("vec"), F.col("w")), 6).alias("error"))


#: Every vector with an id that this divides is a query of the searches for many.
EVERY = 20
_BATCH = f"""WITH {_E}, q AS (SELECT vec_id AS query_id, v AS q FROM e WHERE vec_id % {EVERY} = 0),
    d AS (SELECT query_id, vec_id, 1 - {_COS} AS d FROM e, q),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM d)"""


def _all_queries(e: DataFrame) -> list[tuple[int, list[float]]]:
    return [(r["id"], list(r["vec"])) for r in e.where(F.col("id") % EVERY == 0).orderBy("id").collect()]


@query("knn_batch_topk", f"{_BATCH} SELECT query_id, vec_id, rank, round(d, 6) AS distance FROM r WHERE rank <= {K}")
def knn_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return knn.batch(e, _all_queries(e), K).select("query_id", F.col("id").alias("vec_id"), F.col("rank").cast("long"), F.round("distance", 6).alias("distance"))


@query("cosine_matrix", f"{_BATCH} SELECT query_id, vec_id, round(1 - d, 6) AS similarity FROM r")
def cosine_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return knn.pairs(e, _all_queries(e)).select("query_id", F.col("id").alias("vec_id"), F.round(1 - F.col("distance"), 6).alias("similarity"))


@query("knn_threshold", f"WITH {_E}, {_Q} SELECT vec_id, round({_COS}, 6) AS similarity FROM e, q WHERE {_COS} >= 0.2")
def knn_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return knn.nearest_above(e, vector(e), 0.2).select(F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


@query("knn_filtered_pre", f"WITH {_E}, {_Q} SELECT vec_id, round(1 - {_COS}, 6) AS distance FROM e, q WHERE label = 3 ORDER BY 1 - {_COS}, vec_id LIMIT {K}")
def knn_filtered_pre(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return _top(knn.nearest_where(e, vector(e), K, F.col("label") == 3))


@query(
    "knn_filtered_post",
    f"""WITH {_E}, {_Q}, t AS (SELECT vec_id, label, 1 - {_COS} AS d FROM e, q ORDER BY d, vec_id LIMIT {2 * K})
    SELECT vec_id, round(d, 6) AS distance FROM t WHERE label <> 3 ORDER BY d, vec_id LIMIT {K}""",
)
def knn_filtered_post(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return _top(knn.nearest_where(e, vector(e), K, F.col("label") != 3, first=False))


@query(
    "knn_prefix32_rerank",
    f"""WITH {_E}, {_Q}, c AS (SELECT vec_id, v, q, list_distance(v[1:32], q[1:32]) AS d FROM e, q ORDER BY d, vec_id LIMIT {10 * K})
    SELECT vec_id, round(1 - {_COS}, 6) AS distance FROM c ORDER BY 1 - {_COS}, vec_id LIMIT {K}""",
)
def knn_prefix32_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return _top(knn.two_stage(e, vector(e), K, 10 * K))


# -- inverted file: centroids are the means of the labels

_MEANS = """x AS (SELECT label, vec_id, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM e),
    m AS (SELECT label AS cid, i, avg(x) AS x FROM x GROUP BY label, i),
    c AS (SELECT cid, list(x ORDER BY i) AS c FROM m GROUP BY cid)"""
_ASSIGN = f"""{_MEANS},
    d AS (SELECT vec_id, v, cid, {_D2.format(c="c")} AS d2 FROM e, c),
    a AS (SELECT vec_id, v, cid, d2, row_number() OVER (PARTITION BY vec_id ORDER BY round(d2, 9), cid) AS k FROM d),
    cells AS (SELECT vec_id, v, cid, d2 FROM a WHERE k = 1)"""


def _cells(e: DataFrame) -> tuple[DataFrame, list, np.ndarray]:
    cids, c = ivf.collect_centroids(ivf.means(e, "label").withColumn("cid", F.col("cid").cast("long")))
    return ivf.assigned(e, cids, c), cids, c


@query("ivf_assign", f"WITH {_E}, {_ASSIGN} SELECT vec_id, cid, round(d2, 6) AS d2 FROM cells")
def ivf_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, _, _ = _cells(embeddings(spark, sf_dir))
    return cells.select(F.col("id").alias("vec_id"), "cid", F.round("d2", 6).alias("d2"))


_PROBE = f"""{_Q}, {_ASSIGN},
    p AS (SELECT cid FROM c, q ORDER BY round(list_distance(c, q), 9), cid LIMIT 3)"""


@query("ivf_probe_topk", f"WITH {_E}, {_PROBE} SELECT vec_id, cid, round(1 - {_COS}, 6) AS distance FROM cells, q WHERE cid IN (SELECT cid FROM p) ORDER BY 1 - {_COS}, vec_id LIMIT {K}")
def ivf_probe_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    cells, cids, c = _cells(e)
    q = vector(e)
    return _top(ivf.search(cells, q, K, ivf.probes(q, cids, c, 3)), "cid")


@query(
    "cluster_metrics",
    f"""WITH {_E}, {_ASSIGN}, g AS (SELECT cid, count(*) AS n, avg(d2) AS variance, sqrt(max(d2)) AS radius FROM cells GROUP BY cid)
    SELECT cid, n, round(variance, 6) AS variance, round(radius, 6) AS radius,
    round(CASE WHEN radius = 0 THEN n ELSE n / (1 + radius) END, 6) AS density FROM g""",
)
def cluster_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, _, _ = _cells(embeddings(spark, sf_dir))
    m = ivf.metrics(cells)
    return m.select("cid", "n", *[F.round(x, 6).alias(x) for x in ("variance", "radius", "density")])


@query(
    "adaptive_nprobe",
    f"""WITH {_E}, {_ASSIGN}, s AS (SELECT cid, count(*) AS n FROM cells GROUP BY cid),
    t AS (SELECT count(*) AS cells, sum(n) AS n, min(n) AS lo, max(n) AS hi FROM s)
    SELECT CAST(greatest(1, least(cells, floor(4 * (CASE WHEN lo / hi < 0.1 THEN 0.8 WHEN lo / hi > 0.5 THEN 1.5 ELSE 1.0 END)
           * (CASE WHEN hi > 500 THEN 1.3 ELSE 1.0 END)))) AS BIGINT) AS by_balance,
           CAST(CASE WHEN n < 10000 THEN greatest(1, cells // 4) WHEN n < 100000 THEN greatest(2, cells // 3) ELSE greatest(3, cells // 2) END AS BIGINT) AS by_size
    FROM t""",
)
def adaptive_nprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, _, _ = _cells(embeddings(spark, sf_dir))
    sizes = [r["count"] for r in cells.groupBy("cid").count().collect()]
    row = (ivf.adaptive_nprobe_by_balance(sizes, 4, 1000), ivf.adaptive_nprobe_by_size(sum(sizes), len(sizes)))
    return spark.createDataFrame([row], "by_balance long, by_size long")


# -- product quantization: the codewords are the parts of the vectors 0 to 15

_BOOK = f"""b AS (SELECT vec_id AS code, v AS w FROM e WHERE vec_id < 16),
    d AS (SELECT e.vec_id, m, code, list_distance(v[m * 8 + 1:m * 8 + 8], w[m * 8 + 1:m * 8 + 8]) AS d FROM e, b, range(8) t(m)),
    r AS (SELECT vec_id, m, code, d, row_number() OVER (PARTITION BY vec_id, m ORDER BY round(d * d, 9), code) AS k FROM d),
    codes AS (SELECT vec_id, m, code, d FROM r WHERE k = 1)"""


def _book(e: DataFrame) -> np.ndarray:
    return pq.from_vectors([list(r["vec"]) for r in e.where("id < 16").orderBy("id").collect()], 8)


@query("pq_encode", f"WITH {_E}, {_BOOK} SELECT vec_id, CAST(m AS INTEGER) AS part, CAST(code AS INTEGER) AS code FROM codes")
def pq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return pq.encoded(e, _book(e)).select(F.col("id").alias("vec_id"), F.posexplode("codes").alias("part", "code"))


@query(
    "pq_adc_topk",
    f"""WITH {_E}, {_Q}, {_BOOK}, t AS (SELECT m, code, power(list_distance(q[m * 8 + 1:m * 8 + 8], w[m * 8 + 1:m * 8 + 8]), 2) AS d2 FROM b, q, range(8) t(m)),
    s AS (SELECT vec_id, sum(d2) AS d FROM codes JOIN t USING (m, code) GROUP BY vec_id)
    SELECT vec_id, round(d, 6) AS distance, round(1 / (1 + d), 6) AS similarity FROM s ORDER BY round(d, 9), vec_id LIMIT {K}""",
)
def pq_adc_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    book = _book(e)
    return _top(pq.search(pq.encoded(e, book), vector(e), book, K), F.round("similarity", 6).alias("similarity"))


@query("pq_decode_err", f"WITH {_E}, {_BOOK} SELECT vec_id, round(sqrt(sum(d * d)), 6) AS error FROM codes GROUP BY vec_id")
def pq_decode_err(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    book = _book(e)
    back = pq.decoded(pq.encoded(e, book), book).withColumnRenamed("vec", "w")
    return e.join(back, "id").select(F.col("id").alias("vec_id"), F.round(V.l2(F.col("vec"), F.col("w")), 6).alias("error"))


# -- hashing: normals from an integer formula, so that SQL has them too

BITS, TABLES = 8, 4


def normals(dimension: int = 64) -> np.ndarray:
    return np.array(
        [[[float(((i * 31 + f * 17 + i * f * 7 + 11 + t * 5) % 13) - 6) for i in range(dimension)] for f in range(BITS)] for t in range(TABLES)]
    )


_HASH = f"""p AS (SELECT t, f, list(CAST((((i * 31 + f * 17 + i * f * 7 + 11 + t * 5) % 13) - 6) AS DOUBLE) ORDER BY i) AS n
      FROM range({TABLES}) a(t), range({BITS}) b(f), range(64) c(i) GROUP BY t, f),
    h AS (SELECT vec_id, t AS table_id, CAST(sum(CASE WHEN list_inner_product(v, n) > 0 THEN power(2, f) ELSE 0 END) AS BIGINT) AS hash FROM e, p GROUP BY vec_id, t)"""


@query("lsh_bucket", f"WITH {_E}, {_HASH} SELECT vec_id, CAST(table_id AS INTEGER) AS table_id, hash FROM h")
def lsh_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.index(embeddings(spark, sf_dir), normals()).select(F.col("id").alias("vec_id"), "table_id", "hash")


_CANDIDATES = "s AS (SELECT DISTINCT h.vec_id FROM h JOIN h q0 ON q0.vec_id = 0 AND q0.table_id = h.table_id AND {match})"


@query("lsh_candidates", f"WITH {_E}, {_Q}, {_HASH}, {_CANDIDATES.format(match='q0.hash = h.hash')} SELECT vec_id, round(1 - {_COS}, 6) AS distance FROM e JOIN s USING (vec_id), q ORDER BY 1 - {_COS}, vec_id LIMIT {K}")
def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return _top(lsh.search(e, lsh.index(e, normals()), vector(e), normals(), K))


@query("lsh_multiprobe", f"WITH {_E}, {_HASH}, {_CANDIDATES.format(match='bit_count(xor(q0.hash, h.hash)) <= 1')} SELECT vec_id FROM s")
def lsh_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    probes = lsh.query_probes(spark, vector(e), normals(), 1)
    return lsh.candidates(lsh.index(e, normals()), probes).select(F.col("id").alias("vec_id"))


#: Coefficients of eight MinHash functions, from a rule.
MIN_A = [1_000_003 * (i + 1) for i in range(8)]
MIN_B = [7_919 * (i + 3) for i in range(8)]
_SIG = f"""f AS (SELECT vec_id, unnest(range(len(v))) AS i, unnest(v) AS x FROM e),
    g AS (SELECT vec_id, CAST(i AS BIGINT) * 1000000 + CAST(floor(abs(x) * 1000000) AS BIGINT) AS f FROM f WHERE abs(x) > 1e-9),
    s AS (SELECT vec_id, j, min(((f % 2147483647) * (1000003 * (j + 1)) + 7919 * (j + 3)) % 2147483647) AS h FROM g, range(8) t(j) GROUP BY vec_id, j)"""


def _signed(e: DataFrame) -> DataFrame:
    return e.select("id", H.minhash(H.vector_features(F.col("vec")), MIN_A, MIN_B).alias("sig"))


@query("minhash_sig", f"WITH {_E}, {_SIG} SELECT vec_id, CAST(j AS INTEGER) AS slot, CAST(h AS BIGINT) AS hash FROM s")
def minhash_sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signed(embeddings(spark, sf_dir)).select(F.col("id").alias("vec_id"), F.posexplode("sig").alias("slot", "hash"))


@query("jaccard_est", f"WITH {_E}, {_SIG} SELECT s.vec_id, round(avg(CASE WHEN s.h = o.h THEN 1.0 ELSE 0.0 END), 6) AS jaccard FROM s JOIN s o ON o.vec_id = 0 AND o.j = s.j GROUP BY s.vec_id")
def jaccard_est(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _signed(embeddings(spark, sf_dir))
    own = s.where("id = 0").first()["sig"]
    other = F.array(*[F.lit(x).cast("long") for x in own])
    return s.select(F.col("id").alias("vec_id"), F.round(H.jaccard_estimate(F.col("sig"), other), 6).alias("jaccard"))


# -- clustering, graphs, components


def _lloyd_sql(k: int, rounds: int) -> str:
    out = [f"c0 AS (SELECT CAST(vec_id AS BIGINT) AS cid, v AS c FROM e ORDER BY vec_id LIMIT {k})"]
    for r in range(rounds):
        out.append(f"d{r} AS (SELECT vec_id, v, cid, row_number() OVER (PARTITION BY vec_id ORDER BY round({_D2.format(c='c')}, 9), cid) AS k FROM e, c{r})")
        out.append(f"x{r} AS (SELECT cid, unnest(v) AS x, unnest(range(len(v))) AS i FROM d{r} WHERE k = 1)")
        out.append(f"m{r} AS (SELECT cid, i, avg(x) AS x FROM x{r} GROUP BY cid, i)")
        out.append(f"c{r + 1} AS (SELECT cid, list(x ORDER BY i) AS c FROM m{r} GROUP BY cid)")
    return ", ".join(out)


@query("kmeans_lloyd3", f"WITH {_E}, {_lloyd_sql(4, 3)} SELECT cid, CAST(unnest(range(len(c))) AS INTEGER) AS i, round(unnest(c), 6) AS x FROM c3")
def kmeans_lloyd3(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = kmeans.lloyd(embeddings(spark, sf_dir), 4, 3)
    return c.select("cid", F.posexplode("c").alias("i", "x")).withColumn("x", F.round("x", 6))


@query(
    "knn_graph",
    f"""WITH {_E}, d AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(d, 9), dst) AS rank FROM d)
    SELECT src, dst, rank, round(d, 6) AS distance FROM r WHERE rank <= 8""",
)
def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph.build(embeddings(spark, sf_dir), 8)
    return g.select("src", "dst", F.col("rank").cast("long"), F.round("distance", 6).alias("distance"))


@query("graph_search", f"WITH {_E}, {_Q} SELECT vec_id, round(1 / (1 + list_distance(v, q)), 6) AS similarity FROM e, q WHERE label < 5 ORDER BY list_distance(v, q), vec_id LIMIT {K}")
def graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return graph.search(e, vector(e), K, F.col("label") < 5).select(F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


@query("pca_variance")
def pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = pca.fit(embeddings(spark, sf_dir), target=8)
    return spark.createDataFrame([(i, float(round(x, 6))) for i, x in enumerate(c.variances)], "component int, variance double")


# -- quality of the inverted file against exact search

# -- index searches for every vector whose id is divisible by 20, with parameters that find 9 of 10 true neighbours

PROBES, RADIUS, PARTS, CODES, COARSE = 8, 3, 32, 256, 50

_QUALITY = f"""WITH {_E}, {_ASSIGN}, q AS (SELECT vec_id AS query_id, v AS q FROM e WHERE vec_id % {EVERY} = 0),
    dt AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY 1 - {_COS}, vec_id) AS k FROM e, q),
    truth AS (SELECT query_id, vec_id FROM dt WHERE k <= {K}),
    pd AS (SELECT query_id, q, cid, row_number() OVER (PARTITION BY query_id ORDER BY round(list_distance(c, q), 9), cid) AS k FROM c, q),
    fd AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY 1 - {_COS}, vec_id) AS rank FROM cells JOIN pd USING (cid) WHERE pd.k <= {PROBES}),
    found AS (SELECT * FROM fd WHERE rank <= {K}),
    j AS (SELECT f.query_id, f.rank, t.vec_id IS NOT NULL AS hit FROM found f LEFT JOIN truth t USING (query_id, vec_id)),
    g AS (SELECT query_id, count(*) AS n, sum(CASE WHEN hit THEN 1 ELSE 0 END) AS hits, sum(CASE WHEN hit THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg,
          min(CASE WHEN hit THEN rank END) AS first FROM j GROUP BY query_id)
    SELECT query_id, round(hits / {K}, 6) AS recall, round(hits / n, 6) AS precision,
           round(CASE WHEN hits = 0 THEN 0 ELSE 2 * (hits / {K}) * (hits / n) / ((hits / {K}) + (hits / n)) END, 6) AS f1,
           round(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, {K + 1}) t(i)), 6) AS ndcg, round(coalesce(1 / first, 0), 6) AS mrr FROM g"""


@query(
    "search_quality_estimate",
    f"""{_BATCH}, t AS (SELECT query_id, 1 - d AS s FROM r WHERE rank <= {K})
    SELECT query_id, round(least(1.0, greatest(0.0, 0.4 * least(1.0, count(*) / {K}.0)
      + 0.5 * (1 / (1 + var_pop(s))) * (CASE WHEN max(s) < 0.5 THEN max(s) * 2 ELSE 1 END) + 0.1)), 6) AS quality FROM t GROUP BY query_id""",
)
def search_quality_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    top = knn.batch(e, _all_queries(e), K).withColumn("similarity", 1 - F.col("distance"))
    return quality.estimate(top, K).select("query_id", F.round("quality", 6).alias("quality"))


@query("ivf_quality", _QUALITY)
def ivf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    queries = _all_queries(e)
    _, _, c = _cells(e)
    m = quality.metrics(ivf.batch(e, queries, c, K, PROBES), knn.batch(e, queries, K).select("query_id", "id"))
    return m.select("query_id", *[F.round(x, 6).alias(x) for x in ("recall", "precision", "f1", "ndcg", "mrr")])


@query(
    "lsh_batch_topk",
    f"""WITH {_E}, {_HASH}, s AS (SELECT DISTINCT q0.vec_id AS query_id, h.vec_id FROM h JOIN h q0 ON q0.vec_id % {EVERY} = 0 AND q0.table_id = h.table_id AND bit_count(xor(q0.hash, h.hash)) <= {RADIUS}),
    d AS (SELECT query_id, s.vec_id, 1 - list_cosine_similarity(e.v, o.v) AS d FROM s JOIN e USING (vec_id) JOIN e o ON o.vec_id = query_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM d)
    SELECT query_id, vec_id, rank, round(d, 6) AS distance FROM r WHERE rank <= {K}""",
)
def lsh_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    found = lsh.batch(e, _all_queries(e), normals(), K, RADIUS)
    return found.select("query_id", F.col("id").alias("vec_id"), F.col("rank").cast("long"), F.round("distance", 6).alias("distance"))


_PART = "[m * 2 + 1:m * 2 + 2]"


@query(
    "pq_batch_topk",
    f"""WITH {_E}, b AS (SELECT vec_id AS code, v AS w FROM e WHERE vec_id < {CODES}),
    codes AS (SELECT e.vec_id, m, arg_min(code, (round(power(list_distance(v{_PART}, w{_PART}), 2), 9), code)) AS code FROM e, b, range({PARTS}) t(m) GROUP BY e.vec_id, m),
    qs AS (SELECT vec_id AS query_id, v AS q FROM e WHERE vec_id % {EVERY} = 0),
    t AS (SELECT query_id, m, code, power(list_distance(q{_PART}, w{_PART}), 2) AS d2 FROM qs, b, range({PARTS}) t(m)),
    s AS (SELECT query_id, vec_id, sum(d2) AS d FROM codes JOIN t USING (m, code) GROUP BY query_id, vec_id),
    near AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), vec_id) AS k FROM s),
    x AS (SELECT query_id, vec_id, 1 - list_cosine_similarity(v, q) AS d FROM near JOIN e USING (vec_id) JOIN qs USING (query_id) WHERE k <= {COARSE}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM x)
    SELECT query_id, vec_id, rank, round(d, 6) AS distance FROM r WHERE rank <= {K}""",
)
def pq_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    book = pq.from_vectors([list(r["vec"]) for r in e.where(F.col("id") < CODES).orderBy("id").collect()], PARTS)
    found = pq.batch(e, _all_queries(e), book, K, COARSE)
    return found.select("query_id", F.col("id").alias("vec_id"), F.col("rank").cast("long"), F.round("distance", 6).alias("distance"))
