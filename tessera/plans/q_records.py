"""Queries over events, orders and conversations: merges, paging, statistics, versions, prompts and imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import hybrid, knn, rag, stats, versions
from tessera.plans.catalogue import query
from tessera.plans.q_vector import embeddings, vector
from tessera.sources import ingest
from tessera.sources import store as S
from tessera.sources.tables import table
from tessera.streaming import flows, limits

# -- merging vector and scalar results

_E = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v AS q FROM e WHERE vec_id = 0)"
_V = f"{_E}, vec AS (SELECT vec_id, label, 1 - list_cosine_similarity(v, q) AS d FROM e, q ORDER BY d, vec_id LIMIT 20), sca AS (SELECT vec_id FROM e WHERE label = 3)"
_MERGES = {
    "intersection": "SELECT vec_id, round(d, 6) AS distance FROM vec WHERE label = 3",
    "union": "SELECT vec_id, round(d, 6) AS distance FROM vec UNION ALL SELECT vec_id, 1.0 FROM sca WHERE vec_id NOT IN (SELECT vec_id FROM vec)",
    "vector_first": "SELECT vec_id, round(d, 6) AS distance FROM vec",
    "scalar_first": "SELECT vec_id, CAST(0.0 AS DOUBLE) AS distance FROM sca",
    "weighted": """SELECT coalesce(vec.vec_id, sca.vec_id) AS vec_id, round(CASE WHEN vec.vec_id IS NULL THEN 0.3
        WHEN sca.vec_id IS NULL THEN d * 0.7 ELSE d * 0.7 + 0.03 END, 6) AS distance FROM vec FULL JOIN sca ON vec.vec_id = sca.vec_id""",
}


def _merge(strategy: str) -> None:
    @query(f"hybrid_{strategy}", f"WITH {_V} {_MERGES[strategy]}")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = embeddings(spark, sf_dir)
        near = knn.nearest(e, vector(e), 20).select("id", "distance")
        out = hybrid.merge(near, e.where("label = 3").select("id"), strategy)
        return out.select(F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


for _s in _MERGES:
    _merge(_s)


@query("hybrid_builder", f"WITH {_E}, vec AS (SELECT vec_id, label, 1 - list_cosine_similarity(v, q) AS d FROM e, q ORDER BY d, vec_id LIMIT 60) SELECT vec_id, label FROM vec WHERE label >= 2 AND label < 5 OR label = 8 ORDER BY label DESC, vec_id LIMIT 10 OFFSET 3")
def hybrid_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    q = hybrid.Query().near(vector(e), 60).where("label", "gte", 2).where("label", "lt", 5).either("label", "eq", 8)
    return q.order_by("label", descending=True).limit(10).offset(3).run(e).select(F.col("id").alias("vec_id"), "label")


@query(
    "shard_merge",
    f"WITH {_E}, d AS (SELECT vec_id, 1 - list_cosine_similarity(v, q) AS d FROM e, q) SELECT vec_id, round(d, 6) AS distance FROM d ORDER BY d, vec_id LIMIT 10",
)
def shard_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of three shards' ten nearest, two of them holding some vectors twice, merged."""
    e = embeddings(spark, sf_dir)
    q, at = vector(e), versions.modulo_shard(F.col("id"), 3)
    parts = [knn.nearest(e.where((at == i) | (F.col("label") == 0)), q, 10).select("id", "distance") for i in range(3)]
    return hybrid.top_of_shards(parts[0].unionByName(parts[1]).unionByName(parts[2]), 10).select(F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


# -- predicates, paging, sorting

_PREDICATES = [
    ("eq", "o_orderstatus", "F", "o_orderstatus = 'F'"), ("ne", "o_orderstatus", "F", "o_orderstatus <> 'F'"), ("gt", "o_totalprice", 200000.0, "o_totalprice > 200000"),
    ("gte", "o_custkey", 50, "o_custkey >= 50"), ("lt", "o_totalprice", 50000.0, "o_totalprice < 50000"), ("lte", "o_custkey", 50, "o_custkey <= 50"),
    ("in", "o_orderpriority", ["1-URGENT", "2-HIGH"], "o_orderpriority IN ('1-URGENT', '2-HIGH')"), ("not_in", "o_orderpriority", ["1-URGENT"], "o_orderpriority NOT IN ('1-URGENT')"),
    ("like", "o_orderpriority", "%E%", "o_orderpriority LIKE '%E%'"), ("not_like", "o_orderpriority", "%E%", "o_orderpriority NOT LIKE '%E%'"), ("is_null", "o_orderstatus", None, "o_orderstatus IS NULL"),
    ("is_not_null", "o_orderstatus", None, "o_orderstatus IS NOT NULL"), ("contains", "o_orderpriority", "-", "contains(o_orderpriority, '-')"), ("not_contains", "o_orderpriority", "LOW", "NOT contains(o_orderpriority, 'LOW')"),
]


@query("pred_ops", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS operator, count(*) AS n FROM orders WHERE {sql}" for n, _, _, sql in _PREDICATES) + ")")
def pred_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fourteen comparisons in one pass over the table."""
    counts = [F.count(F.when(hybrid.predicate(c, n, v), 1)).alias(n) for n, c, v, _ in _PREDICATES]
    one = table(spark, sf_dir, "orders").agg(*counts)
    return one.unpivot([], [n for n, *_ in _PREDICATES], "operator", "n")


@query("paging", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("down", -F.col("o_totalprice"))
    return S.page(rows, 2, 25, ["down", "o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("sort_nulls", "SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS p FROM orders ORDER BY p DESC NULLS FIRST, o_orderkey")
def sort_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"))
    return rows.orderBy(F.desc_nulls_first("p"), "o_orderkey")


# -- monitoring: event types stand for strategies, user ids for sources


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("percentiles", "SELECT event_type, " + ", ".join(f"round(quantile_cont(value, {p}), 6) AS {n}" for n, p in stats.PERCENTILES.items()) + " FROM events GROUP BY event_type")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = stats.percentiles(events(spark, sf_dir), "value", ["event_type"])
    return p.select("event_type", *[F.round(n, 6).alias(n) for n in stats.PERCENTILES])


@query(
    "anomalies_3sigma",
    """WITH s AS (SELECT event_type, count(*) AS n, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY event_type)
    SELECT event_id, value FROM events JOIN s USING (event_type) WHERE n >= 10 AND abs(value - m) > 3 * sd""",
)
def anomalies_3sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.anomalies(events(spark, sf_dir), "value", ["event_type"]).select("event_id", "value")


@query(
    "insights",
    """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most,
    round(coalesce(stddev_samp(value), 0), 6) AS deviation FROM events GROUP BY event_type""",
)
def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = stats.insights(events(spark, sf_dir), "event_type", "value")
    return i.withColumn("mean", F.round("mean", 6)).withColumn("deviation", F.round("deviation", 6))


@query("last_records", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 100")
def last_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.latest(events(spark, sf_dir), ["event_type"], ["ts", "event_id"], 100).select("event_type", "event_id")


_QUALITY = "1 - value / (1 + value)"


@query(
    "trend_halves",
    f"""WITH r AS (SELECT event_type, value, {_QUALITY} AS quality, count(*) OVER (PARTITION BY event_type) AS n,
      row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
    a AS (SELECT event_type, avg(CASE WHEN k <= floor(n / 2) THEN value END) AS l1, avg(CASE WHEN k > floor(n / 2) THEN value END) AS l2,
      avg(CASE WHEN k <= floor(n / 2) THEN quality END) AS q1, avg(CASE WHEN k > floor(n / 2) THEN quality END) AS q2 FROM r WHERE n >= 10 GROUP BY event_type),
    c AS (SELECT event_type, (l2 - l1) / l1 * 100 AS dl, (q2 - q1) / q1 * 100 AS dq FROM a)
    SELECT event_type, round(dl, 6) AS latency_change, round(dq, 6) AS quality_change,
      CASE WHEN dl > 20 OR dq < -10 THEN 'degrading' WHEN dl < -20 OR dq > 10 THEN 'improving' ELSE 'stable' END AS trend FROM c""",
)
def trend_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("quality", F.expr(_QUALITY))
    t = stats.trend(e, "event_type", ["ts", "event_id"], "value", "quality")
    return t.withColumn("latency_change", F.round("latency_change", 6)).withColumn("quality_change", F.round("quality_change", 6))


@query("strategy_rank", f"SELECT event_type, count(*) AS n, round(avg(0.6 * ({_QUALITY}) + 0.4 / (1 + value / 1000)), 6) AS score FROM events GROUP BY event_type HAVING count(*) >= 5")
def strategy_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("quality", F.expr(_QUALITY))
    return stats.strategy_ranking(e, "event_type", "quality", "value").withColumn("score", F.round("score", 6))


@query(
    "data_quality",
    """WITH a AS (SELECT count(*) AS n, avg(CASE WHEN value > 5 THEN 1.0 ELSE 0.0 END) AS v, count(DISTINCT event_type) AS s,
      (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS sec FROM events)
    SELECT n, round(v, 6) AS valid_share, s AS strategies, round(sec, 3) AS seconds,
      CASE WHEN v > 0.95 AND s >= 3 THEN 'excellent' WHEN v > 0.8 AND s >= 2 THEN 'good' WHEN v > 0.6 THEN 'fair' ELSE 'poor' END AS grade FROM a""",
)
def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = stats.data_quality(events(spark, sf_dir), "event_type", F.col("value") > 5, "ts")
    return d.withColumn("valid_share", F.round("valid_share", 6)).withColumn("seconds", F.round("seconds", 3))


_NAME = "event_type || CASE user_id % 3 WHEN 0 THEN '_total' WHEN 1 THEN '_bytes' ELSE '_time' END"


@query(
    "metric_kinds",
    f"""WITH r AS (SELECT {_NAME} AS name, value, ts, event_id FROM events),
    a AS (SELECT name, count(*) AS n, sum(value) AS s, arg_max(value, (ts, event_id)) AS l, avg(value) AS m FROM r GROUP BY name)
    SELECT name, CASE WHEN name LIKE '%_total' THEN 'counter' WHEN name LIKE '%_bytes' THEN 'gauge' ELSE 'histogram' END AS kind, n,
      round(CASE WHEN name LIKE '%_total' THEN s WHEN name LIKE '%_bytes' THEN l ELSE m END, 4) AS value FROM a""",
)
def metric_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("name", F.expr(_NAME))
    m = stats.metric_kinds(e, "name", "value", ["ts", "event_id"])
    return m.select("name", "kind", "n", F.round("value", 4).alias("value"))


@query(
    "ema_value",
    """WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, max(n) AS n, round(sum(value * power(0.9, n - k) * (CASE WHEN k = 1 THEN 1.0 ELSE 0.1 END)), 6) AS average FROM r GROUP BY user_id""",
)
def ema_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.moving_average(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], "value").withColumn("average", F.round("average", 6))


@query("value_histogram", "SELECT CAST(floor(value / 10) * 10 AS DOUBLE) AS low, count(*) AS n FROM events GROUP BY 1")
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(events(spark, sf_dir), "value", 10.0).withColumn("low", F.col("low").cast("double"))


@query(
    "alert_gaps",
    """WITH f AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events WHERE value > 80)
    SELECT event_id, user_id FROM f WHERE p IS NULL OR epoch_us(ts) - epoch_us(p) >= 600000000""",
)
def alert_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.alerts(events(spark, sf_dir), ["user_id"], "ts", F.col("value") > 80, 600).select("event_id", "user_id")


def _fold(rows: str, first: str, step: str, state: str) -> str:
    """SQL that folds the rows of each user in order of time; ``n`` is the next row, ``s`` the state after the one before."""
    return f"""WITH RECURSIVE r AS (SELECT event_id, user_id, ts, epoch_us(ts) / 1000000.0::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM {rows}),
    f AS (SELECT event_id, user_id, ts, t, k, {first} FROM r WHERE k = 1
      UNION ALL SELECT event_id, user_id, ts, t, k, {step} FROM (SELECT n.*, {state} FROM f s JOIN r n ON n.user_id = s.user_id AND n.k = s.k + 1))
    SELECT event_id, user_id, ts, allowed FROM f"""


_ALERTS = _fold("events WHERE value > 80", "true AS allowed, t AS last", "t - last >= 600, CASE WHEN t - last >= 600 THEN t ELSE last END", "s.last AS last")


@query("alert_cooldown", f"SELECT event_id, user_id, ts FROM ({_ALERTS}) WHERE allowed")
def alert_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    fired = events(spark, sf_dir).where("value > 80").select("event_id", "user_id", "ts")
    return limits.admitted(fired, lambda: limits.Cooldown(600), "user_id", "ts", ["event_id"]).where("allowed").drop("allowed")


@query("rate_token_bucket", _fold("events", "true AS allowed, 2.0::DOUBLE AS tokens", "held >= 1, CASE WHEN held >= 1 THEN held - 1 ELSE held END", "least(3.0::DOUBLE, s.tokens + (n.t - s.t) * 0.001::DOUBLE) AS held"))
def rate_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "user_id", "ts")
    return limits.admitted(e, lambda: limits.TokenBucket(0.001, 3), "user_id", "ts", ["event_id"])


@query("rate_sliding_window", _fold("events", "true AS allowed, [t] AS past", "len(past) < 3, CASE WHEN len(past) < 3 THEN list_append(past, t) ELSE past END", "list_filter(s.past, lambda x: x > n.t - 3600) AS past"))
def rate_sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "user_id", "ts")
    return limits.admitted(e, lambda: limits.SlidingWindow(0.001, 3600), "user_id", "ts", ["event_id"])


_NEW = "t - began > 3600"


@query(
    "rate_fixed_window",
    _fold(
        "events", "true AS allowed, t AS began, 1 AS held", f"CASE WHEN {_NEW} THEN true ELSE held < 3 END, CASE WHEN {_NEW} THEN t ELSE began END, CASE WHEN {_NEW} THEN 1 WHEN held < 3 THEN held + 1 ELSE held END",
        "s.began AS began, s.held AS held",
    ),
)
def rate_fixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "user_id", "ts")
    return limits.admitted(e, lambda: limits.FixedWindow(0.001, 3600), "user_id", "ts", ["event_id"])


@query(
    "context_similarity",
    """WITH r AS (SELECT event_id, CAST(floor(value * 100) AS BIGINT) AS c, 32 + 32 * (user_id % 5) AS d, (epoch_us(TIMESTAMP '2024-03-01') - epoch_us(ts)) / 3600000000.0 AS h FROM events)
    SELECT event_id, round(CASE WHEN greatest(c, 5000.0) / greatest(1.0, least(c, 5000.0)) > 10 OR greatest(d, 64.0) / greatest(1.0, least(d, 64.0)) > 2 THEN 0.1
      ELSE greatest(0.0, least(1.0, 0.5 * (CASE WHEN c > 0 THEN 1 - abs(c - 5000) / greatest(c, 5000.0) ELSE 0.1 END) + 0.3 * (1 - abs(d - 64) / greatest(d, 64.0)) + 0.2 * exp(-h / 24.0))) END, 6) AS similarity FROM r""",
)
def context_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = (F.lit(1709251200000000) - stats.micros("ts")) / F.lit(3600000000.0)
    s = stats.context_similarity(F.floor(F.col("value") * 100).cast("long"), 32 + 32 * (F.col("user_id") % 5), hours, 5000, 64)
    return events(spark, sf_dir).select("event_id", F.round(s, 6).alias("similarity"))


@query("pick_strategy", f"SELECT event_type, round(avg(({_QUALITY}) * 0.9), 6) AS score FROM events GROUP BY event_type HAVING count(*) >= 2 ORDER BY avg(({_QUALITY}) * 0.9) DESC, event_type LIMIT 1")
def pick_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = stats.pick_strategy(events(spark, sf_dir), "event_type", F.expr(_QUALITY), F.lit(0.9))
    return best.select("event_type", F.round("score", 6).alias("score"))


_COUNTED = ("region", "nation", "customer", "orders")


@query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _COUNTED) + " UNION ALL SELECT NULL, " + " + ".join(f"(SELECT count(*) FROM {t})" for t in _COUNTED))
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.table_counts({t: table(spark, sf_dir, t) for t in _COUNTED})


# -- versions: an order's version stands until the customer's next one

_VERSIONS = """v AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) AS b, lead(epoch_us(o_orderdate), 1, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS e,
    o_orderstatus <> 'P' AS c FROM orders)"""


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    begin = stats.micros("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", begin.alias("begin_ts"), F.lead(begin, 1, 0).over(w).alias("end_ts"), (F.col("o_orderstatus") != "P").alias("committed"), F.lit(0).alias("tx_id")
    )


@query("mvcc_visible", f"WITH {_VERSIONS} SELECT o_custkey, o_orderkey FROM v WHERE c AND b <= 852076800000000 AND (e = 0 OR e > 852076800000000)")
def mvcc_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versions(spark, sf_dir).where(versions.visible("repeatable_read", F.lit(852076800000000))).select("o_custkey", "o_orderkey")


@query("mvcc_as_of", "SELECT o_custkey, max(o_orderdate) AS o_orderdate FROM orders WHERE o_orderdate <= TIMESTAMP '1997-01-01' GROUP BY o_custkey")
def mvcc_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    return versions.as_of(rows.withColumn("begin_ts", F.col("o_orderdate")), "o_custkey", F.to_timestamp(F.lit("1997-01-01"))).select("o_custkey", "o_orderdate")


@query("range_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 900")
def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.range_scan(table(spark, sf_dir, "orders"), "o_orderkey", 100, 900).select("o_orderkey", "o_totalprice")


_POINT = "CAST(('0x' || substr(md5({}), 1, 8)) AS BIGINT)"


@query(
    "hash_ring",
    f"""WITH r AS (SELECT n_name AS node, {_POINT.format("n_name || '#' || c")} AS p FROM nation, range(3) t(c)),
    k AS (SELECT c_custkey, {_POINT.format("CAST(c_custkey AS VARCHAR)")} AS p FROM customer),
    f AS (SELECT c_custkey, arg_min(node, (r.p, node)) AS node FROM k JOIN r ON r.p >= k.p GROUP BY c_custkey)
    SELECT k.c_custkey, coalesce(f.node, (SELECT arg_min(node, (p, node)) FROM r)) AS node FROM k LEFT JOIN f ON f.c_custkey = k.c_custkey""",
)
def hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = versions.ring(table(spark, sf_dir, "nation"), "n_name")
    return versions.on_ring(table(spark, sf_dir, "customer").select("c_custkey"), places, "c_custkey")


@query("shard_mod", "SELECT vec_id, vec_id % 7 AS shard FROM embeddings")
def shard_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select(F.col("id").alias("vec_id"), versions.modulo_shard(F.col("id"), 7).alias("shard"))


@query(
    "deadlocks",
    """WITH RECURSIVE w AS (SELECT DISTINCT user_id AS waiter, event_id % (SELECT max(user_id) + 1 FROM events) AS holder FROM events WHERE event_type = 'error'),
    reach AS (SELECT waiter, holder FROM w UNION SELECT r.waiter, w.holder FROM reach r JOIN w ON w.waiter = r.holder) SELECT DISTINCT waiter AS tx FROM reach WHERE waiter = holder""",
)
def deadlocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits among all users: the one of an error event waits for the one that the event's id falls to."""
    e = events(spark, sf_dir)
    users = e.agg(F.max("user_id")).first()[0] or 0
    waits = e.where("event_type = 'error'").select(F.col("user_id").alias("waiter"), (F.col("event_id") % F.lit(users + 1)).alias("holder"))
    return versions.deadlocked(waits)


# -- conversations and prompts


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


@query("history_turns", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 3")
def history_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.last_turns(messages(spark, sf_dir), 3).select("conv_id", "turn", "role")


_TRIMMED = "t AS (SELECT * FROM (SELECT *, sum(CAST(floor(length(text) / 2) AS BIGINT)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS s FROM conversations) WHERE s <= 400)"


@query("history_tokens", f"WITH {_TRIMMED} SELECT conv_id, turn FROM t")
def history_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rag.last_tokens(messages(spark, sf_dir), 400).select("conv_id", "turn")


@query(
    "prompt_text",
    f"""WITH {_TRIMMED}, h AS (SELECT conv_id, string_agg(CASE WHEN role = 'assistant' THEN '助手' ELSE '用户' END || '：' || text, chr(10) ORDER BY turn) AS h FROM t GROUP BY conv_id)
    SELECT conv_id, md5('系统指令：be brief' || chr(10) || '历史对话：' || chr(10) || h || chr(10) || '知识库内容：' || chr(10) || 'facts' || chr(10) || '用户问题：why?') AS prompt FROM h""",
)
def prompt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = rag.history_text(rag.last_tokens(messages(spark, sf_dir), 400))
    p = rag.prompt(F.lit("facts"), F.col("history"), F.lit("why?"), "be brief")
    return h.select("conv_id", F.md5(p.cast("binary")).alias("prompt"))


@query(
    "rag_context",
    f"""WITH {_E}, n AS (SELECT vec_id, 1 - list_cosine_similarity(v, q) AS d FROM e, q ORDER BY d, vec_id LIMIT 5)
    SELECT md5(string_agg(text, chr(10) ORDER BY d, vec_id)) AS context, count(*) AS n FROM n JOIN documents ON doc_id = vec_id""",
)
def rag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    near = knn.nearest(e, vector(e), 5).select("id", "distance")
    contents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    n = near.join(contents.select("id"), "id", "left_semi").agg(F.count("*").alias("n"))
    return rag.context(near, contents).select(F.md5(F.col("context").cast("binary")).alias("context")).crossJoin(n)


@query(
    "knowledge_retrieval",
    f"""WITH {_E}, s AS (SELECT vec_id, list_cosine_similarity(v, q) AS s, (label + 1) / 10.0 AS c FROM e, q)
    SELECT vec_id, round(s * c, 6) AS relevance FROM s WHERE s >= 0.1 ORDER BY s * c DESC, vec_id LIMIT 3""",
)
def knowledge_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    found = rag.knowledge(e.withColumn("confidence", (F.col("label") + 1) / 10.0), vector(e), 0.1)
    return found.select(F.col("id").alias("vec_id"), F.round("relevance", 6).alias("relevance"))


@query("memory_retrieval", f"WITH {_E}, s AS (SELECT vec_id, label, list_cosine_similarity(v, q) AS s FROM e, q) SELECT vec_id, label + 1 AS used_count FROM s WHERE s >= 0.1 ORDER BY s DESC, vec_id LIMIT 5")
def memory_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir).withColumn("used_count", F.col("label"))
    return rag.memories(e, vector(e), 0.1).select(F.col("id").alias("vec_id"), F.col("used_count"))


@query("session_expiry", "SELECT event_id AS session_id FROM events WHERE ts <= TIMESTAMP '2024-01-10' ORDER BY ts, event_id LIMIT 100")
def session_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir).select(F.col("event_id").alias("session_id"), F.col("ts").alias("expires"))
    return rag.expired_sessions(s, F.to_timestamp(F.lit("2024-01-10"))).select("session_id")


@query("session_oldest", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS session_id FROM events GROUP BY user_id")
def session_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir).select("user_id", F.col("event_id").alias("session_id"), F.col("ts").alias("expires"))
    return rag.oldest_session(s)


@query("session_versions", "SELECT user_id AS session_id, max(event_id) AS version FROM events GROUP BY user_id")
def session_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir).select(F.col("user_id").alias("session_id"), F.col("event_id").alias("version"), "props")
    return rag.latest_versions(s).select("session_id", "version")


# -- imports and text about tables


@query(
    "row_to_doc",
    r"""SELECT CAST(c_custkey AS VARCHAR) AS doc_id, CAST(c_nationkey AS BIGINT) AS bits,
      len(list_distinct(list_append(regexp_extract_all(c_name, '\S+'), c_name))) + len(list_distinct(list_append(regexp_extract_all(c_mktsegment, '\S+'), c_mktsegment))) AS n_keywords,
      c_name || ' ' || c_mktsegment AS content FROM customer""",
)
def row_to_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ingest.documents(table(spark, sf_dir, "customer"), "c_custkey", ["c_name", "c_mktsegment"], ["c_name", "c_mktsegment"], "c_nationkey", {"c_name": "name"})
    return d.select("doc_id", "bits", F.size("keywords").cast("long").alias("n_keywords"), "content")


@query("doc_keywords", "SELECT doc_id, field, word FROM (SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS doc_id, 'name' AS field, unnest(list_append(string_split(p_name, ' '), p_name)) AS word FROM part)")
def doc_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ingest.documents(table(spark, sf_dir, "part"), "p_partkey", ["p_name"], names={"p_name": "name"})
    return d.select("doc_id", F.explode("keywords").alias("k")).select("doc_id", "k.field", "k.word")


@query("incremental_rows", "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01'")
def incremental_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    import datetime

    return ingest.changed_ids(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderdate", datetime.datetime(1998, 1, 1))


@query("many_tables", "SELECT 'part' AS \"table\", count(*) AS n FROM part UNION ALL SELECT 'nation', count(*) FROM nation")
def many_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = ingest.many_tables({t: table(spark, sf_dir, t) for t in ("part", "nation")})
    return both.groupBy("table").agg(F.count("*").alias("n"))


@query("row_text", "SELECT n_nationkey, concat_ws(', ', CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR)) AS text FROM nation")
def row_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return n.select("n_nationkey", ingest.row_text(n).alias("text"))


@query(
    "qa_pairs",
    """WITH n AS (SELECT count(*) AS n FROM nation), f AS (SELECT * FROM nation ORDER BY n_nationkey LIMIT 1)
    SELECT 0 AS n, '<s>[INST] What columns are in the nation table? [/INST] The nation table has the following columns: n_nationkey, n_name, n_regionkey</s>' AS text
    UNION ALL SELECT 1, '<s>[INST] How many rows are in the nation table? [/INST] The nation table has ' || n || ' rows.</s>' FROM n
    UNION ALL SELECT 2, '<s>[INST] What is the primary key of the nation table? [/INST] The primary key of the nation table is n_nationkey</s>'
    UNION ALL SELECT 3, '<s>[INST] Show me an example row from the nation table. [/INST] Here is an example row: n_nationkey=' || n_nationkey || ', n_name=' || n_name || ', n_regionkey=' || n_regionkey || '</s>' FROM f
    UNION ALL SELECT 4, '<s>[INST] How can I query the nation table for a record with n_nationkey=' || n_nationkey || '? [/INST] You can use the following SQL query:' || chr(10)
      || 'SELECT * FROM nation WHERE n_nationkey = ' || n_nationkey || ';</s>' FROM f""",
)
def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.qa_pairs("nation", table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_nationkey"])


@query(
    "training_text",
    """WITH f AS (SELECT * FROM nation ORDER BY n_nationkey LIMIT 5),
    l AS (SELECT string_agg('Row: n_nationkey=' || n_nationkey || ', n_name=' || n_name, chr(10) ORDER BY n_nationkey) AS l FROM f)
    SELECT 'Table: nation' || chr(10) || 'Columns: n_nationkey, n_name' || chr(10) || chr(10) || chr(10) || 'Data Examples:' || chr(10) || l || chr(10) || chr(10) || 'SQL Query Examples:' || chr(10)
      || 'SELECT * FROM nation LIMIT 5;' || chr(10) || 'SELECT COUNT(*) FROM nation;' || chr(10) || 'SELECT * FROM nation WHERE n_nationkey = <value>;' AS text FROM l""",
)
def training_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return ingest.training_text("nation", n, keys=["n_nationkey"], order=["n_nationkey"])


@query("describe_tables", "SELECT 'nation' AS \"table\", 3 AS columns, count(*) AS rows FROM nation UNION ALL SELECT 'part', 6, count(*) FROM part")
def describe_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ingest.describe(spark, {t: table(spark, sf_dir, t) for t in ("nation", "part")})
    return d.groupBy("table").agg(F.count("*").cast("int").alias("columns"), F.max("rows").alias("rows"))


@query("upsert_delete", "SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN label + 100 ELSE label END AS label FROM embeddings WHERE vec_id % 7 <> 0")
def upsert_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth row replaced, then every seventh deleted."""
    e = embeddings(spark, sf_dir).select("id", "label")
    now = S.upserted(e, e.where("id % 5 = 0").withColumn("label", F.col("label") + 100), "id")
    return S.without(now, e.where("id % 7 = 0"), "id").select(F.col("id").alias("vec_id"), "label")


@query("score_ids", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS score_id FROM orders")
def score_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_score_ids(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", F.col("score_id").cast("long"))


@query("encrypted_values", "SELECT n_nationkey, n_name FROM nation")
def encrypted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.lit("0123456789abcdef")
    n = table(spark, sf_dir, "nation").select("n_nationkey", S.encrypted(F.col("n_name"), key).alias("secret"))
    return n.select("n_nationkey", S.decrypted(F.col("secret"), key).cast("string").alias("n_name"))


@query("json_values", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# -- streams


@query("stream_tumbling", "SELECT event_type, time_bucket(INTERVAL 6 HOURS, ts) AS began, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    total = [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")]
    out = flows.replay(spark, f"{sf_dir}/events.parque[t]", e.schema, lambda r: flows.tumbling(r, "ts", "6 hours", ["event_type"], *total, late="10 days"), "complete")
    return out.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("began"), "n", "total")


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    out = flows.replay(spark, f"{sf_dir}/events.parque[t]", e.schema, lambda r: flows.distinct_within(r, "ts", ["user_id", "event_type"], "1000 days"))
    return out.select("user_id", "event_type")
