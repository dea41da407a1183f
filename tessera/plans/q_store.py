"""Queries through stores, files, logs and caches: what is written must come back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import balance, hybrid, ivf, kmeans, knn, postings, rag, versions, weights
from tessera.plans import selector, sqlmini
from tessera.plans.catalogue import query
from tessera.plans.durable import shared_folder
from tessera.plans.q_vector import _E, _MEANS, _Q, K, embeddings, vector
from tessera.sources import cache, ingest, log
from tessera.sources.store import Store
from tessera.sources.tables import table


def _store(spark: SparkSession) -> Store:
    return Store(spark, shared_folder(spark, "store"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")


# -- tables of a store


@query("store_batch_add", "SELECT doc_id, lang, n_chars FROM documents")
def store_batch_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even ids make the table, then all odd ones are added at once."""
    d, store = _docs(spark, sf_dir), _store(spark)
    store.create("docs", d.where("doc_id % 2 = 0"))
    store.upsert("docs", d.where("doc_id % 2 = 1"), "doc_id")
    return store.read("docs")


@query("store_batch_delete", "SELECT doc_id, n_chars FROM documents WHERE doc_id % 3 <> 0")
def store_batch_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, store = _docs(spark, sf_dir), _store(spark)
    store.create("docs", d)
    store.delete("docs", d.where("doc_id % 3 = 0"), "doc_id")
    store.vacuum("docs")
    return store.read("docs").select("doc_id", "n_chars")


@query("store_delete_postings", r"SELECT doc_id, count(DISTINCT w) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^\s\x0B]+')) AS w FROM documents WHERE doc_id % 5 <> 0) GROUP BY doc_id")
def store_delete_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and their postings are taken out of both tables."""
    d, store = table(spark, sf_dir, "documents"), _store(spark)
    store.create("postings", postings.build(d, {"text": "body"}))
    store.delete("postings", d.where("doc_id % 5 = 0"), "doc_id")
    return store.read("postings").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("store_update", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents")
def store_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, store = _docs(spark, sf_dir), _store(spark)
    store.create("docs", d)
    store.update("docs", d.where("doc_id % 4 = 0").withColumn("n_chars", F.col("n_chars") + 1), "doc_id")
    return store.read("docs").select("doc_id", "n_chars")


@query("store_get", "SELECT doc_id, lang FROM documents WHERE doc_id % 20 = 0")
def store_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by a table of keys."""
    d, store = _docs(spark, sf_dir), _store(spark)
    store.create("docs", d)
    return store.get("docs", d.where("doc_id % 20 = 0").select("doc_id"), "doc_id").select("doc_id", "lang")


@query("store_tables", "SELECT * FROM (VALUES ('customer', 'kept'), ('nation', 'kept')) t(name, state)")
def store_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables are made and one is dropped."""
    store = _store(spark)
    for t in ("customer", "nation", "region"):
        store.create(t, table(spark, sf_dir, t))
    store.drop("region")
    return spark.createDataFrame([(t, "kept") for t in store.tables()], "name string, state string")


@query("store_restore", "SELECT c_custkey, c_name FROM customer")
def store_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table comes back from its backup after all rows were deleted."""
    store, folder = _store(spark), shared_folder(spark, "backup")
    store.create("customer", table(spark, sf_dir, "customer"))
    store.backup("customer", folder)
    store.delete("customer", store.read("customer"), "c_custkey")
    store.restore("customer", folder)
    return store.read("customer").select("c_custkey", "c_name")


@query("store_backups", "SELECT 'customer' AS name, count(*) AS rows FROM customer UNION ALL SELECT 'nation', count(*) FROM nation")
def store_backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, folder = _store(spark), shared_folder(spark, "backup")
    for t in ("customer", "nation"):
        store.create(t, table(spark, sf_dir, t))
        store.backup(t, folder)
    return store.backups(folder)


@query("store_increments", "SELECT o_orderkey, o_totalprice FROM orders")
def store_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders up to 1995 are imported, then those that are newer than the newest there."""
    o, store = table(spark, sf_dir, "orders"), _store(spark)
    store.import_increment("orders", o.where("o_orderdate <= timestamp '1995-06-30'"), "o_orderkey", "o_orderdate")
    store.import_increment("orders", o, "o_orderkey", "o_orderdate")
    return store.read("orders").select("o_orderkey", "o_totalprice")


@query("score_ids_wide", "SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) + 100 AS score_id FROM orders")
def score_ids_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in the order of a key of two columns, beside other columns."""
    from tessera.sources.store import with_score_ids

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.struct("o_totalprice", "o_orderkey").alias("key"))
    return with_score_ids(o, "key", after=100).select("o_orderkey", "o_custkey", "o_totalprice", "score_id")


@query("postings_from_store", r"SELECT w AS word, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^\s\x0B]+')) AS w FROM documents) GROUP BY w")
def postings_from_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings are built anew from the documents that a store holds."""
    store = _store(spark)
    store.create("docs", table(spark, sf_dir, "documents"))
    return postings.build(store.read("docs"), {"text": "body"}).groupBy("word").agg(F.count("*").alias("n"))


# -- files


@query("word_vectors_file", "SELECT n_name AS word, CAST(n_nationkey AS DOUBLE) AS first, n_regionkey / 4.0 AS second FROM nation WHERE n_name NOT LIKE '% %'")
def word_vectors_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word vectors written as lines and loaded again."""
    folder = shared_folder(spark, "words")
    n = table(spark, sf_dir, "nation").where("n_name not like '% %'")
    n.select(F.concat_ws(" ", "n_name", F.col("n_nationkey").cast("string"), (F.col("n_regionkey") / 4).cast("string"))).write.text(folder)
    w = ingest.word_embeddings(spark, folder, 2)
    return w.select("word", F.get("vec", 0).alias("first"), F.get("vec", 1).alias("second"))


@query("text_files", "SELECT n_regionkey AS region, string_agg(n_name, chr(10) ORDER BY n_name) || chr(10) AS text FROM nation GROUP BY n_regionkey")
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text file for each region, found by its extension and read."""
    folder = shared_folder(spark, "files")
    n = table(spark, sf_dir, "nation").repartition("n_regionkey").sortWithinPartitions("n_regionkey", "n_name")
    n.select("n_regionkey", F.col("n_name").alias("value")).write.partitionBy("n_regionkey").text(folder)
    read = ingest.read_files(ingest.scan_files(spark, folder, ["txt"]))
    return read.select(F.regexp_extract("path", r"n_regionkey=(\d+)", 1).cast(table(spark, sf_dir, "nation").schema["n_regionkey"].dataType).alias("region"), "text")


@query("folder_pages", "SELECT 'n_regionkey=' || n_regionkey AS name FROM (SELECT DISTINCT n_regionkey FROM nation) ORDER BY 1 LIMIT 2 OFFSET 2")
def folder_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of two folders."""
    from tessera.sources.store import page

    folder = shared_folder(spark, "files")
    table(spark, sf_dir, "nation").write.partitionBy("n_regionkey").parquet(folder)
    files = ingest.scan_files(spark, folder, ["parquet"])
    return page(files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("name")).distinct(), 1, 2, ["name"])


@query("config_values", "SELECT '[' || (row_number() OVER (ORDER BY n_nationkey) - 1) || '].name' AS path, n_name AS value FROM nation UNION ALL SELECT '[' || (row_number() OVER (ORDER BY n_nationkey) - 1) || '].keys[0]', CAST(n_regionkey AS VARCHAR) FROM nation")
def config_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of a JSON text made from a table of nations."""
    one = F.struct(F.col("n_name").alias("name"), F.array("n_regionkey").alias("keys"))
    line = table(spark, sf_dir, "nation").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", one.alias("n")))).alias("l"))
    text = line.select(F.to_json(F.transform("l", lambda x: x["n"]))).first()[0]
    return spark.createDataFrame(ingest.parse_config(text, "json"), "path string, value string")


# -- logs, locks, caches, balancing

_ENTRIES = """e AS (SELECT event_id * 2 AS lsn, user_id AS tx, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, CAST(event_id % 97 AS VARCHAR) AS key, CAST(event_id AS VARCHAR) AS value FROM events),
    done AS (SELECT DISTINCT tx FROM e WHERE tx % 3 <> 0)"""


@query("log_replay", f"WITH {_ENTRIES}, l AS (SELECT key, arg_max(op, lsn) AS op, arg_max(value, lsn) AS value, max(lsn) AS lsn FROM e WHERE tx IN (SELECT tx FROM done) GROUP BY key) SELECT key, value, lsn FROM l WHERE op = 'put'")
def log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes of users whose number isn't divisible by three are committed; those of the others are aborted."""
    e = table(spark, sf_dir, "events")
    writes = e.select(
        (F.col("event_id") * 2).cast("long").alias("lsn"), F.col("user_id").cast("long").alias("tx"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"),
        (F.col("event_id") % 97).cast("string").alias("key"), F.col("event_id").cast("string").alias("value"),
    )
    end = F.when(F.col("tx") % 3 == 0, "abort").otherwise("commit")
    ends = writes.groupBy("tx").agg((F.max("lsn") + 1).alias("lsn")).select("lsn", "tx", end.alias("op"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"))
    path = shared_folder(spark, "log")
    log.append(writes, path)
    log.append(ends, path)
    return log.replayed(log.compacted(log.read(spark, path)))


@query(
    "lock_conflicts",
    """WITH l AS (SELECT o_orderkey AS tx, o_custkey * 10 AS low, o_custkey * 10 + o_orderkey % 15 AS high, o_orderstatus <> 'F' AS shared FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT a.tx AS a, b.tx AS b FROM l a JOIN l b ON a.tx < b.tx AND a.low <= b.high AND b.low <= a.high AND NOT (a.shared AND b.shared)""",
)
def lock_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders lock a range of keys that begins at their customer's."""
    low = F.col("o_custkey") * 10
    locks = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(
        F.col("o_orderkey").alias("tx"), low.alias("low"), (low + F.col("o_orderkey") % 15).alias("high"), (F.col("o_orderstatus") != "F").alias("shared")
    )
    return versions.lock_conflicts(locks, 20)


@query("sharing_views", "WITH v AS (SELECT DISTINCT event_id AS tx, (event_id * 13 + user_id) % 20011 AS active FROM events) SELECT tx FROM v WHERE active IN (SELECT active FROM v GROUP BY active HAVING count(*) > 1)")
def sharing_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return versions.sharing_views(e.select(F.col("event_id").alias("tx"), ((F.col("event_id") * 13 + F.col("user_id")) % 20011).alias("active")))


_USED = "u AS (SELECT user_id AS key, max(ts) AS last_used, count(*) AS uses, min(ts) AS created FROM events GROUP BY user_id)"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key"))
    return by.agg(F.max("ts").alias("last_used"), F.count("*").alias("uses"), F.min("ts").alias("created"))


@query("cache_lru", f"WITH {_USED} SELECT key FROM u ORDER BY last_used DESC, key LIMIT 50")
def cache_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.kept(_entries(spark, sf_dir), 50, "lru").select("key")


@query("cache_lfu", f"WITH {_USED} SELECT key FROM u ORDER BY uses DESC, last_used DESC, key LIMIT 50")
def cache_lfu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.kept(_entries(spark, sf_dir), 50, "lfu").select("key")


@query("cache_fresh", f"WITH {_USED} SELECT key, uses FROM u WHERE created > TIMESTAMP '2024-01-02' - INTERVAL 12 HOURS")
def cache_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.fresh(_entries(spark, sf_dir), F.lit("2024-01-02").cast("timestamp_ntz"), 43_200).select("key", "uses")


@query("cached_search", f"WITH {_E}, {_Q} SELECT vec_id, round(1 - list_cosine_similarity(v, q), 6) AS distance FROM e, q ORDER BY 1 - list_cosine_similarity(v, q), vec_id LIMIT {K}")
def cached_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second search of the same vector reads what the first one kept."""
    e, store = embeddings(spark, sf_dir), _store(spark)
    q = vector(e)
    key = e.where("id = 0").select(F.expr("md5(array_join(transform(vec, x -> format_string('%.6f', x)), ','))")).first()[0]
    for _ in range(2):
        found = cache.cached(store, key, lambda: knn.nearest(e, q, K).select("id", "distance"))
    return found.select(F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


@query("balance_rounds", "SELECT event_id, CAST(CASE (row_number() OVER (ORDER BY ts, event_id) - 1) % 6 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS INTEGER) AS node FROM events")
def balance_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three nodes with the weights 3, 1 and 2."""
    return balance.in_turn(table(spark, sf_dir, "events"), ["ts", "event_id"], [3, 1, 2]).select("event_id", "node")


@query("balance_by_key", "SELECT event_id, CAST(CAST(('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8)) AS BIGINT) % 5 AS INTEGER) AS node FROM events")
def balance_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", balance.by_key(F.col("user_id"), 5).alias("node"))


@query("balance_least", "SELECT user_id AS node FROM events GROUP BY user_id ORDER BY count(*), user_id LIMIT 1")
def balance_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("node")).agg(F.count("*").alias("load"))
    return balance.least_loaded(load, "load").select("node")


# -- sessions, tables side by side, statements


@query(
    "session_documents",
    """SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS content, len(list_distinct(list(role))) + 1 AS n_keywords,
      list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 2147483647) AS score_id
    FROM conversations GROUP BY conv_id""",
)
def session_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = rag.session_documents(table(spark, sf_dir, "conversations"))
    return s.select("conv_id", "content", F.size("keywords").cast("long").alias("n_keywords"), "score_id")


@query(
    "session_search",
    r"""WITH w AS (SELECT conv_id, unnest(regexp_extract_all(lower(text), '[^\s\x0B]+')) AS w FROM conversations),
    s AS (SELECT conv_id FROM w GROUP BY conv_id HAVING bool_or(w = 'the') AND (bool_or(w = 'in') OR bool_or(w = 'of')))
    SELECT conv_id, turn, role FROM conversations WHERE conv_id IN (SELECT conv_id FROM s)""",
)
def session_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of sessions whose words satisfy a boolean query."""
    c = table(spark, sf_dir, "conversations")
    s = rag.session_documents(c)
    q = postings.Term("body", "the").also(postings.Term("body", "in").either(postings.Term("body", "of")))
    found = postings.search(postings.build(s, {"content": "body"}, "conv_id"), q)
    return c.join(found, c["conv_id"] == found["doc_id"], "left_semi").select("conv_id", "turn", "role")


@query(
    "tables_search",
    r"""WITH a AS (SELECT 'documents' AS name, CAST(doc_id AS VARCHAR) AS id, regexp_extract_all(lower(text), '[^\s\x0B]+') AS w FROM documents
      UNION ALL SELECT 'benchmark', CAST(item_id AS VARCHAR), regexp_extract_all(lower(text), '[^\s\x0B]+') FROM benchmark)
    SELECT name, id, CAST((CASE WHEN list_contains(w, 'the') THEN 1 ELSE 0 END) + (CASE WHEN list_contains(w, 'que') THEN 1 ELSE 0 END) AS BIGINT) AS n_hits
    FROM a WHERE list_contains(w, 'the') OR list_contains(w, 'que')""",
)
def tables_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables searched for the same words, with each hit's table."""
    parts = {"documents": "doc_id", "benchmark": "item_id"}
    found = {t: postings.hits(postings.build(table(spark, sf_dir, t), {"text": "body"}, k), ["the", "que"]) for t, k in parts.items()}
    return ingest.many_tables({t: f.withColumn("id", F.col("doc_id").cast("string")).select("id", "n_hits") for t, f in found.items()}).withColumnRenamed("table", "name")


@query("read_only_sql", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def read_only_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement of a caller over named tables."""
    return spark.sql(sqlmini.read_only("select lang, count(*) as n from {docs} group by lang;").replace("{docs}", "{d}"), d=_docs(spark, sf_dir))


@query("term_texts", "SELECT * FROM (VALUES (1, 'body' || chr(1) || 'a'), (2, '(body' || chr(1) || 'a&body' || chr(1) || 'b)'), (3, '(body' || chr(1) || 'c|(body' || chr(1) || 'a&body' || chr(1) || 'b))'), (4, '')) t(n, text)")
def term_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = (postings.Term("body", w) for w in "abc")
    texts = [str(a), str(a.also(b)), str(c.either(a.also(b))), str(postings.Term())]
    return spark.createDataFrame(list(enumerate(texts, 1)), "n int, text string")


@query("hooked_rows", "SELECT CAST(c_custkey AS VARCHAR) AS doc_id, lower(c_name) || ' ' || upper(c_mktsegment) AS content FROM customer WHERE c_nationkey < 20")
def hooked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, then documents, each through a caller's function."""
    rows = ingest.transformed(table(spark, sf_dir, "customer"), [lambda d: d.where("c_nationkey < 20"), lambda d: d.withColumn("c_name", F.lower("c_name"))])
    docs = ingest.transformed(rows, lambda d: d.withColumn("c_mktsegment", F.upper("c_mktsegment")))
    return ingest.documents(docs, "c_custkey", [], ["c_name", "c_mktsegment"]).select("doc_id", "content")


# -- vectors: samples, increments, choices

_POINT = "CAST(('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8)) AS BIGINT)"


@query("random_sample", "SELECT vec_id FROM embeddings ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id LIMIT 64")
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.sample(embeddings(spark, sf_dir), 64).select(F.col("id").alias("vec_id"))


@query("training_sample", f"SELECT vec_id FROM embeddings WHERE {_POINT} < 429496729 OR {_POINT} = (SELECT min({_POINT}) FROM embeddings)")
def training_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.training_sample(embeddings(spark, sf_dir), 0.1).select(F.col("id").alias("vec_id"))


_HALF = _MEANS.replace("FROM e)", "FROM e WHERE vec_id % 2 = 0)", 1)
_D2 = "list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"


@query(
    "ivf_increment",
    f"""WITH {_E}, {_HALF}, d AS (SELECT vec_id, cid, {_D2} AS d2 FROM e, c),
    a AS (SELECT vec_id, cid, d2, row_number() OVER (PARTITION BY vec_id ORDER BY round(d2, 9), cid) AS k FROM d) SELECT vec_id, cid, round(d2, 6) AS d2 FROM a WHERE k = 1""",
)
def ivf_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the even ids are stored; the odd ones are then put into the same cells."""
    e, store = embeddings(spark, sf_dir), _store(spark)
    even = e.where("id % 2 = 0")
    cids, c = ivf.collect_centroids(ivf.means(even, "label").withColumn("cid", F.col("cid").cast("long")))
    store.create("cells", ivf.assigned(even, cids, c))
    store.upsert("cells", ivf.assigned(e.where("id % 2 = 1"), cids, c), "id")
    return store.read("cells").select(F.col("id").alias("vec_id"), "cid", F.round("d2", 6).alias("d2"))


@query(
    "ivf_moved_centroids",
    f"""WITH {_E}, {_MEANS}, d AS (SELECT vec_id, v, cid, row_number() OVER (PARTITION BY vec_id ORDER BY round({_D2}, 9), cid) AS k FROM e, c),
    y AS (SELECT cid, unnest(v) AS x, unnest(range(len(v))) AS i FROM d WHERE k = 1) SELECT cid, CAST(i AS INTEGER) AS i, round(avg(x), 6) AS x FROM y GROUP BY cid, i""",
)
def ivf_moved_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.streaming.flows import update_centroids

    e = embeddings(spark, sf_dir)
    cids, c = ivf.collect_centroids(ivf.means(e, "label").withColumn("cid", F.col("cid").cast("long")))
    return update_centroids(e, cids, c).select("cid", F.posexplode("c").alias("i", "x")).withColumn("x", F.round("x", 6))


_SIZES = [(n, d) for n in (500, 20_000, 60_000, 2_000_000) for d in (64, 300, 700, 3_000)]


@query(
    "index_plans",
    f"""SELECT n, d, CASE WHEN n < 10000 THEN 100 WHEN n < 100000 THEN 256 WHEN n < 1000000 THEN 1024 ELSE 4096 END AS cells,
      CASE WHEN d >= 512 THEN 16 WHEN d >= 256 THEN 8 WHEN d >= 128 THEN 4 ELSE 2 END AS parts,
      CASE WHEN n < 10000 THEN 16 WHEN n < 100000 THEN 32 WHEN n < 1000000 THEN 64 WHEN n < 10000000 THEN 96 ELSE 128 END AS links,
      CASE WHEN n > 1000000 THEN 1024 // 10 WHEN n > 100000 THEN 1024 // 20 ELSE greatest(1, 1024 // 50) END AS probes,
      CASE WHEN n < 1000 THEN 'brute_force' WHEN d > 1000 THEN 'enhanced_lsh' ELSE 'ivf' END AS strategy
    FROM (VALUES {", ".join(map(str, _SIZES))}) t(n, d)""",
)
def index_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of each kind of index by the number of vectors and their dimension."""
    from tessera.operators import graph

    rows = [(n, d, selector.ivf_cells(n), selector.pq_parts(d), graph.hnsw_settings(n)[0], ivf.static_nprobe(n, 1024), selector.hybrid_dispatch(n, d, True)) for n, d in _SIZES]
    return spark.createDataFrame(rows, "n int, d int, cells int, parts int, links int, probes int, strategy string")


@query(
    "strategy_choices",
    f"""SELECT n, d, CASE WHEN n < 1000 THEN 'brute_force' WHEN n > 50000 AND d >= 256 THEN 'ivf_hnsw' WHEN n > 10000 AND d >= 128 AND d <= 2048 THEN 'enhanced_ivf'
      WHEN n > 10000 AND d > 512 THEN 'enhanced_lsh' WHEN d > 2048 THEN 'ivf_hnsw' ELSE 'ivf_hnsw' END AS strategy FROM (VALUES {", ".join(map(str, _SIZES))}) t(n, d)""",
)
def strategy_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With every index at hand and a quality of 0.8, without a time limit."""
    ready = frozenset(selector.health(frozenset()))
    rows = [(n, d, selector.choose(selector.Situation(n, d, 0.8, ready=ready))) for n, d in _SIZES]
    return spark.createDataFrame(rows, "n int, d int, strategy string")


@query(
    "weighted_embedding",
    r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\s\x0B]+')) AS word FROM documents), t AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY doc_id, word)
    SELECT doc_id, round(sum(length(word) * ln(1 + n)) / sum(ln(1 + n)), 6) AS first FROM t GROUP BY doc_id""",
)
def weighted_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word vectors weighted by the logarithm of their counts; a word's vector here is its length."""
    d = table(spark, sf_dir, "documents")
    known = weights.term_counts(d).select("word").distinct().withColumn("vec", F.array(F.length("word").cast("double")))
    m = weights.mean_embedding(d, known, weight=F.ln(1 + F.col("n")))
    return m.select("doc_id", F.round(F.get("vec", 0), 6).alias("first"))


@query(
    "variable_bytes",
    """WITH b AS (SELECT o_orderkey, bin(o_orderkey) AS b FROM orders), p AS (SELECT o_orderkey, lpad(b, CAST(ceil(length(b) / 7.0) * 7 AS INTEGER), '0') AS p FROM b)
    SELECT o_orderkey, array_to_string(list_transform(range(0, length(p) // 7), lambda i: (CASE WHEN i = length(p) // 7 - 1 THEN '1' ELSE '0' END) || substr(p, CAST(i * 7 + 1 AS BIGINT), 7)), '') AS code FROM p""",
)
def variable_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", T.variable_byte_digits(F.col("o_orderkey")).alias("code"))


@query("filtered_graph_merge", f"WITH {_E}, {_Q}, n AS (SELECT vec_id, label, 1 - list_cosine_similarity(v, q) AS d FROM e, q ORDER BY d, vec_id LIMIT 40) SELECT vec_id, label FROM n WHERE label <> 3 AND label <= 7 ORDER BY d, vec_id LIMIT 12")
def filtered_graph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = hybrid.Query().near(vector(embeddings(spark, sf_dir)), 40).unless("label", "eq", 3).where("label", "lte", 7).limit(12)
    return q.run(embeddings(spark, sf_dir)).select(F.col("id").alias("vec_id"), "label")


_CUT = ["the", "that", "with", "ción", "ciónes", "que", "queue", "ein", "eine", "sch", "é", "的", "一个", "a"]


@query("segmented_text", f"SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS segments FROM (SELECT doc_id, regexp_extract_all(text, '{T.segments(_CUT)}') AS s FROM documents)")
def segmented_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", T.segmented(F.col("text"), _CUT).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|").cast("binary")).alias("segments"))


@query("shard_hash", f"SELECT vec_id, CAST({_POINT} % 7 AS INTEGER) AS shard FROM embeddings")
def shard_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select(F.col("id").alias("vec_id"), versions.hash_shard(F.col("id"), 7).alias("shard"))


@query("codebook_versions", "SELECT * FROM (VALUES (1, 64), (2, 64)) t(version, words)")
def codebook_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two trainings of one codebook of 8 parts with 8 codes, and what the store then holds."""
    from tessera.operators import pq

    e, store = embeddings(spark, sf_dir), _store(spark)
    for _ in range(2):
        pq.train_version(store, "book", e, 8, 8, rounds=1)
    rows = [(v, store.read(f"book-{v}").count()) for v in pq.versions_of(store, "book")]
    return spark.createDataFrame(rows, "version int, words int")


@query("job_order", "SELECT * FROM (VALUES (1, 'import', 'done'), (2, 'cells', 'done'), (3, 'backup', 'done'), (4, 'count', 'done')) t(n, job, state)")
def job_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that wait for each other over a store: import, cells (first among the ready), backup, counts."""
    from tessera.streaming.jobs import Job, Jobs

    e, store, ran = embeddings(spark, sf_dir), _store(spark), []
    jobs = Jobs()
    jobs.add(Job("count", lambda: ran.append(("count", store.counts()["vectors"])), after=("backup", "cells")))
    jobs.add(Job("backup", lambda: (store.backup("vectors", shared_folder(spark, "backup")), ran.append(("backup", 0))), after=("import",)))
    jobs.add(Job("cells", lambda: ran.append(("cells", ivf.means(store.read("vectors"), "label").count())), after=("import",), priority=1))
    jobs.add(Job("import", lambda: (store.create("vectors", e), ran.append(("import", 0)))))
    for name in jobs.order():
        jobs.jobs[name].run()
    return spark.createDataFrame([(i, name, "done") for i, (name, _) in enumerate(ran, 1)], "n int, job string, state string")
