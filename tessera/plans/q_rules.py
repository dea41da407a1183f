"""Queries over hash families, keys of vectors, cells' upkeep, components and search histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import bits as B
from tessera.functions import lsh as H
from tessera.functions import vectors as V
from tessera.operators import ivf, knn, lsh, pca, quality, stats
from tessera.plans.catalogue import query
from tessera.plans.q_vector import _ASSIGN, _E, _HASH, _Q, EVERY, K, _cells, embeddings, normals, vector
from tessera.sources.tables import table

# -- hash families: normals from the formula of the hyperplane hashes

_N = "p AS (SELECT f, list(CAST((((i * 31 + f * 17 + i * f * 7 + 11) % 13) - 6) AS DOUBLE) ORDER BY i) AS n FROM range(8) b(f), range(64) c(i) GROUP BY f)"


@query("lsh_projection", f"WITH {_E}, {_N} SELECT vec_id, CAST(f AS INTEGER) AS f, CAST(abs(floor((list_inner_product(v, n) + f / 4.0) / 3.0)) AS BIGINT) AS hash FROM e, p")
def lsh_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random projections and p-stable hashes: an offset of f / 4 and cells of width 3."""
    hashes = F.array(*[H.projection_hash(F.col("vec"), n, f / 4, 3.0).cast("long") for f, n in enumerate(normals()[0].tolist())])
    return embeddings(spark, sf_dir).select(F.col("id").alias("vec_id"), F.posexplode(hashes).alias("f", "hash"))


@query("lsh_angular", f"WITH {_E}, {_N} SELECT vec_id, CAST(f AS INTEGER) AS f, CAST(list_inner_product(v, n) >= 0 AS BIGINT) AS hash FROM e, p")
def lsh_angular(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashes = F.array(*[H.angular_hash(F.col("vec"), n) for n in normals()[0].tolist()])
    return embeddings(spark, sf_dir).select(F.col("id").alias("vec_id"), F.posexplode(hashes).alias("f", "hash"))


@query("lsh_combined", f"WITH {_E}, {_N}, h AS (SELECT vec_id, f, CAST(list_inner_product(v, n) >= 0 AS BIGINT) AS h FROM e, p) SELECT vec_id, CAST(sum(h << f) AS BIGINT) AS hash FROM h GROUP BY vec_id")
def lsh_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight one-bit hashes, each rotated by its place and joined by exclusive or."""
    e = embeddings(spark, sf_dir)
    return e.select(F.col("id").alias("vec_id"), H.combined([H.angular_hash(F.col("vec"), n) for n in normals()[0].tolist()]).alias("hash"))


_SHARED = f"c AS (SELECT q0.vec_id AS query_id, count(DISTINCT h.vec_id) AS n FROM h JOIN h q0 ON q0.vec_id % {EVERY} = 0 AND q0.table_id = h.table_id AND q0.hash = h.hash GROUP BY q0.vec_id)"


def _candidate_counts(e: DataFrame) -> DataFrame:
    """``query_id`` and ``n``: how many vectors share a bucket with each query."""
    index = lsh.index(e, normals())
    asked = index.where(F.col("id") % EVERY == 0).withColumnRenamed("id", "query_id")
    return index.join(asked, ["table_id", "hash"]).groupBy("query_id").agg(F.count_distinct("id").alias("n"))


@query("lsh_candidate_bars", f"WITH {_E}, {_HASH}, {_SHARED} SELECT CAST(floor(n / 10) * 10 AS DOUBLE) AS low, count(*) AS n FROM c GROUP BY 1")
def lsh_candidate_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries by tens of candidates."""
    return stats.histogram(_candidate_counts(embeddings(spark, sf_dir)), "n", 10.0).withColumn("low", F.col("low").cast("double"))


@query(
    "lsh_candidate_average",
    f"""WITH {_E}, {_HASH}, {_SHARED}, r AS (SELECT n, row_number() OVER (ORDER BY query_id) AS k, count(*) OVER () AS m FROM c)
    SELECT max(m) AS n, round(sum(n * power(0.9, m - k) * (CASE WHEN k = 1 THEN 1.0 ELSE 0.1 END)), 6) AS average FROM r""",
)
def lsh_candidate_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exponential average of the number of candidates, in order of the queries."""
    c = _candidate_counts(embeddings(spark, sf_dir)).withColumnRenamed("n", "candidates")
    return stats.moving_average(c, [], ["query_id"], "candidates").withColumn("average", F.round("average", 6))


# -- keys


@query("vector_keys", f"WITH {_E} SELECT vec_id, md5(array_to_string(list_transform(v, lambda x: printf('%.6f', x)), ',') || '|10|3') AS key FROM e")
def vector_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key under which a search for 10 neighbours in 3 cells is kept."""
    return embeddings(spark, sf_dir).select(F.col("id").alias("vec_id"), V.cache_key(F.col("vec"), 10, 3).alias("key"))


@query(
    "string_hashes",
    "SELECT c_custkey, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(c_name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 2147483647) AS hash FROM customer",
)
def string_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", V.poly_hash(F.col("c_name")).alias("hash"))


@query("key_ranges", "SELECT o_orderkey, o_orderkey <= 500 + o_custkey AND o_custkey * 3 <= o_orderkey + 1000 AS meets FROM orders")
def key_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    meets = B.ranges_overlap(F.col("o_orderkey"), F.col("o_orderkey") + 1000, F.col("o_custkey") * 3, F.lit(500) + F.col("o_custkey"))
    return o.select("o_orderkey", meets.alias("meets"))


# -- cells


@query(
    "candidate_cells",
    f"""WITH {_E}, {_Q}, {_ASSIGN}, g AS (SELECT cid, count(*) AS n, sqrt(max(d2)) AS radius FROM cells GROUP BY cid)
    SELECT cid, n, round(list_distance(c, q) ** 2, 6) AS distance FROM g JOIN c USING (cid), q
    ORDER BY round(list_distance(c, q) ** 2, 9), CASE WHEN radius = 0 THEN n ELSE n / (1 + radius) END DESC, abs(n - 50), cid LIMIT 4""",
)
def candidate_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    cells, cids, c = _cells(e)
    centroids = spark.createDataFrame([(i, x.tolist()) for i, x in zip(cids, c, strict=True)], "cid long, c array<double>")
    found = ivf.candidate_cells(ivf.metrics(cells), centroids, vector(e), 4, 50.0)
    return found.select("cid", "n", F.round("distance", 6).alias("distance"))


@query("cells_out_of_bounds", f"WITH {_E}, {_ASSIGN}, g AS (SELECT cid, count(*) AS n FROM cells GROUP BY cid) SELECT least, most, (SELECT bool_or(n < least OR n > most) FROM g) AS rebuild FROM (VALUES (1, 1000000), (40, 60), (1, 10)) t(least, most)")
def cells_out_of_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether cells need to be built anew, for three pairs of bounds."""
    cells, _, _ = _cells(embeddings(spark, sf_dir))
    return spark.createDataFrame([(a, b, ivf.needs_rebuild(cells, a, b)) for a, b in ((1, 1_000_000), (40, 60), (1, 10))], "least int, most int, rebuild boolean")


# -- principal components: all of them keep lengths and the total variance


_CENTRED = "m AS (SELECT i, avg(x) AS m FROM (SELECT unnest(v) AS x, unnest(range(len(v))) AS i FROM e) GROUP BY i), y AS (SELECT vec_id, x - m AS x, i FROM (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM e) JOIN m USING (i))"


@query("pca_lengths", f"WITH {_E}, {_CENTRED} SELECT vec_id, round(sqrt(sum(x * x)), 5) AS length FROM y GROUP BY vec_id")
def pca_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return pca.applied(e, pca.fit(e)).select(F.col("id").alias("vec_id"), F.round(V.norm(F.col("reduced")), 5).alias("length"))


@query("pca_total_variance", f"WITH {_E}, {_CENTRED}, s AS (SELECT i, var_samp(x) AS s FROM y GROUP BY i) SELECT round(sum(s), 6) AS variance FROM s")
def pca_total_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = pca.fit(embeddings(spark, sf_dir))
    return spark.createDataFrame([(round(float(c.variances.sum()), 6),)], "variance double")


# -- search histories: event types stand for settings

_HISTORY = "h AS (SELECT event_type AS settings, 1 / (1 + value) AS recall, value / (1 + value) AS precision, value AS ms FROM events)"


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("settings"), (1 / (1 + v)).alias("recall"), (v / (1 + v)).alias("precision"), v.alias("ms"))


@query("search_effectiveness", "SELECT event_id, round(0.4 / (1 + value) + 0.4 * value / (1 + value) + 0.2 * greatest(0.0, 1 - value / 100), 6) AS effectiveness FROM events")
def search_effectiveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _history(spark, sf_dir)
    return h.select("event_id", F.round(quality.effectiveness(F.col("recall"), F.col("precision"), F.col("ms")), 6).alias("effectiveness"))


@query("tuned_settings", f"WITH {_HISTORY}, a AS (SELECT settings, avg(0.4 * recall + 0.4 * precision + 0.2 * greatest(0.0, 1 - ms / 100)) AS e FROM h GROUP BY settings) SELECT settings, round(e, 6) AS effectiveness FROM a ORDER BY e DESC, settings LIMIT 1")
def tuned_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.tuned(_history(spark, sf_dir)).select("settings", F.round("effectiveness", 6).alias("effectiveness"))


@query("results_above", f"WITH {_E}, {_Q}, n AS (SELECT vec_id, list_cosine_similarity(v, q) AS s FROM e, q ORDER BY 1 - list_cosine_similarity(v, q), vec_id LIMIT {5 * K}) SELECT vec_id, round(s, 6) AS similarity FROM n WHERE s >= 0.5 * 0.6")
def results_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of fifty neighbours those that a quality of 0.6 asks for."""
    e = embeddings(spark, sf_dir)
    return quality.above(knn.nearest(e, vector(e), 5 * K), 0.6).select(F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"))
