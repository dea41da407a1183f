import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.plans import sqlmini
from tessera.sources import ingest
from tessera.sources import store as S
from tessera.streaming import flows, jobs, limits


def test_documents_from_rows(spark):
    rows = spark.createDataFrame([(" 7 ", "red  wine", "5", None), (None, "x", "1", "y"), ("8", None, "no", "z")], "id string, name string, flags string, note string")
    got = {r["doc_id"]: r for r in ingest.documents(rows, "id", ["name"], "*", "flags", {"name": "title"}).collect()}
    assert set(got) == {"7", "8"} and got["7"]["bits"] == 5 and got["8"]["bits"] == 0
    assert [(k["field"], k["word"]) for k in got["7"]["keywords"]] == [("title", "red"), ("title", "wine"), ("title", "red  wine")]
    assert got["8"]["keywords"] == [] and got["8"]["content"] == "8 no z"
    with pytest.raises(ValueError):
        ingest.documents(rows, "id", ["nothing"])


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.TXT").write_text("plain é")
    (tmp_path / "sub" / "b.html").write_text("<p>hi<script>no</script> there</p>")
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>one</w:t></w:r><w:r><w:t> two</w:t></w:r></w:p><w:p/></w:body></w:document>')
    (tmp_path / "c.docx").write_bytes(raw.getvalue())
    (tmp_path / "d.docx").write_text("broken")
    (tmp_path / "e.bin").write_text("no")
    files = ingest.scan_files(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["error"] is None) for r in ingest.read_files(files).collect()}
    assert got == {"a.TXT": ("plain é", True), "b.html": ("hi there", True), "c.docx": ("one two\n\n", True), "d.docx": (None, False)}


def test_embeddings_and_config(spark, tmp_path):
    (tmp_path / "e.txt").write_text("2 3\nking 1 2 3\nqueen 4 5 6\nbad 1 2\n")
    got = {r["word"]: r["vec"] for r in ingest.word_embeddings(spark, str(tmp_path / "e.txt"), 3).collect()}
    assert got == {"king": [1, 2, 3], "queen": [4, 5, 6]}
    assert ingest.parse_config('{"a": {"b": [1, null]}}', "json") == [("a.b[0]", "1"), ("a.b[1]", None)]
    assert ingest.parse_config("[s]\nk = v\n", "ini") == [("s.k", "v")]
    with pytest.raises(ValueError):
        ingest.parse_config("", "toml")


def test_text_about_tables(spark):
    df = spark.createDataFrame([(2, "b"), (1, None)], "k long, v string")
    assert "  - k bigint (PK) \n" in ingest.table_text("t", df, 2, ["k"])
    assert ingest.training_text("t", df, order=["k"]).first()["text"].splitlines()[5] == "Row: k=1, v=None"
    assert ingest.qa_pairs("t", df).count() == 4 and ingest.qa_pairs("t", df, ["k"]).count() == 5


def test_store(spark, tmp_path):
    s = S.Store(spark, str(tmp_path / "store"))
    assert s.tables() == []
    rows = spark.createDataFrame([(1, [1.0, 2.0], 10), (2, [3.0, 4.0], 20)], "id long, vec array<double>, t long")
    s.create("v", rows)
    with pytest.raises(ValueError):
        s.create("v", rows)
    s.upsert("v", spark.createDataFrame([(2, [9.0, 9.0], 21), (3, [5.0, 6.0], 30)], rows.schema))
    assert {r["id"]: r["t"] for r in s.read("v").collect()} == {1: 10, 2: 21, 3: 30}
    with pytest.raises(ValueError):
        s.upsert("v", spark.createDataFrame([(4, [1.0], 1)], rows.schema))
    with pytest.raises(KeyError):
        s.update("v", spark.createDataFrame([(4, [1.0, 1.0], 1)], rows.schema))
    s.delete("v", spark.createDataFrame([(1,)], "id long"))
    assert [r["id"] for r in s.get("v", [1, 2]).collect()] == [2] and s.counts() == {"v": 2}
    assert s.import_increment("v", spark.createDataFrame([(5, [0.0, 0.0], 25), (6, [0.0, 0.0], 40)], rows.schema), "id", "t") == 1
    s.backup("v", str(tmp_path / "saved"))
    s.restore("v2", str(tmp_path / "saved"), "v")
    assert s.tables() == ["v", "v2"] and s.read("v2").count() == 3 and s.vacuum("v") == 3
    s.drop("v")
    assert s.tables() == ["v2"]
    with pytest.raises(KeyError):
        s.read("v")


def test_dialect(spark):
    t = spark.createDataFrame([(1, "Ann", 5.5, True), (2, "bob", None, False), (3, "Cid", 7.0, None)], "doc_id long, name string, x double, ok boolean")
    run = lambda q, **k: [r["doc_id"] for r in sqlmini.execute(q, {"t": t}, **k).collect()]
    assert run("SELECT * FROM t WHERE name = 'Ann' OR x >= 7 ORDER BY doc_id") == [1, 3]
    assert run("select doc_id from t where (name like '%b' or ok) and not doc_id in (7, 8) order by doc_id desc -- note") == [2, 1]
    assert run("SELECT doc_id FROM t ORDER BY x") == [1, 3, 2] and run("SELECT doc_id FROM t ORDER BY x DESC LIMIT 2") == [2, 3]
    assert run("SELECT doc_id FROM t WHERE x IS NULL") == [2] and run("SELECT doc_id FROM t WHERE x IS NOT NULL AND doc_id BETWEEN 2 AND 3") == [3]
    assert run("SELECT doc_id FROM t WHERE name <> 'O''Hara' AND true ORDER BY doc_id LIMIT 1 OFFSET 1") == [2]
    assert run("SELECT doc_id FROM t WHERE false") == [] and run("SELECT doc_id FROM t ORDER BY doc_id", default_limit=1) == [1]
    found = lambda w: t.where(F.col("name") == w).select("doc_id")
    assert run("SELECT doc_id FROM t WHERE _keyword_ = 'bob'", keyword=found) == [2]
    both = {"keyword": found, "vector": lambda w: t.where("doc_id > 1").select("doc_id")}
    assert run("SELECT doc_id FROM t WHERE _keyword_ = 'bob' AND _vector_ = 'x'", **both) == [2] and run("SELECT doc_id FROM t WHERE _keyword_ = 'Ann' AND _vector_ = 'x'", **both) == [1]
    for bad in ("", "SELECT FROM t", "SELECT a t", "SELECT * FROM t WHERE", "SELECT * FROM t LIMIT -1", "SELECT * FROM t WHERE a = 'x", "SELECT * FROM t x", "SELECT * FROM t WHERE a NOT = 1"):
        with pytest.raises(sqlmini.ParseError):
            sqlmini.parse(bad)
    for good in ("SELECT id, name FROM users WHERE age > 18 ORDER BY name LIMIT 10", "SELECT * FROM logs ORDER BY ts DESC, id LIMIT 5 OFFSET 10"):
        assert sqlmini.parse(good).limit in (10, 5)
    with pytest.raises(ValueError):
        run("SELECT doc_id FROM u")


def test_search_queries_and_guard():
    q = sqlmini.parse_search("SELECT * FROM docs WHERE keyword='a b' AND vector_query='near' AND k=7 AND use_ann=true AND or_flags=[1, 6] ORDER BY x DESC LIMIT 3 OFFSET 2")
    assert (q.table, q.keyword, q.text(), q.k, q.probe, q.use_ann, q.or_flags, q.limit, q.offset, q.order) == ("docs", "a b", "near", 7, 10, True, (1, 6), 3, 2, (("x", True),))
    assert sqlmini.read_only(" select 1 -- x\n;") == "select 1"
    for bad in ("drop table t", "select 1; select 2", "with a as (select 1) insert into t select * from a"):
        with pytest.raises(ValueError):
            sqlmini.read_only(bad)


def test_limits():
    b = limits.TokenBucket(1.0, 2.0)
    assert [b.allow(t) for t in (0, 0, 0, 1, 1.5, 2)] == [True, True, False, True, False, True]
    w = limits.SlidingWindow(0.5, 4)
    assert [w.allow(t) for t in (0, 1, 2, 4, 4.5, 5.1)] == [True, True, False, True, False, True]
    f = limits.FixedWindow(0.5, 4)
    assert [f.allow(t) for t in (0, 1, 2, 4, 4.5, 5)] == [True, True, False, False, True, True]
    c = limits.Cooldown(10)
    assert [c.allow(t) for t in (0, 9, 10, 15, 20)] == [True, False, True, False, True]


def test_limit_over_a_stream_equals_batch(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    rule = lambda: limits.SlidingWindow(0.0001, 36_000)
    batch = {(r["event_id"], r["allowed"]) for r in limits.admitted(events, rule, "user_id", "ts", ["event_id"]).collect()}
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    live = flows.replay(
        spark, f"{sf}/events.parque[t]", schema, lambda r: limits.stream(r.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")), rule, "user_id", "ts", ["event_id"])
    )
    assert {(r["event_id"], r["allowed"]) for r in live.collect()} == batch and len({a for _, a in batch}) == 2


def test_import_stream(spark, sf, tmp_path):
    s = S.Store(spark, str(tmp_path / "s"))
    rows = spark.readStream.schema(spark.read.parquet(f"{sf}/orders.parquet").schema).parquet(f"{sf}/orders.parque[t]")
    for _ in range(2):
        q = rows.writeStream.foreachBatch(flows.import_into(s, "orders", "o_orderkey")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert s.read("orders").count() == spark.read.parquet(f"{sf}/orders.parquet").count()


def test_jobs():
    log, tries = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("not yet")
        return "done"

    j = jobs.Jobs()
    j.add(jobs.Job("b", lambda: log.append("b"), after=("a",)))
    j.add(jobs.Job("a", lambda: log.append("a"), every_seconds=10))
    j.add(jobs.Job("c", flaky, priority=5, retries=2))
    j.add(jobs.Job("d", lambda: 1 / 0))
    j.add(jobs.Job("e", lambda: log.append("e"), after=("d",)))
    assert j.order() == ["c", "a", "b", "d", "e"]
    done = j.run_due(100)
    assert done["c"] == "done" and isinstance(done["d"], ZeroDivisionError) and isinstance(done["e"], RuntimeError) and log == ["a", "b"]
    assert j.due(105) == ["e"] and j.due(110) == ["a", "e"]
    j.add(jobs.Job("f", lambda: 0, after=("g",)))
    with pytest.raises(ValueError):
        j.order()
    j.add(jobs.Job("g", lambda: 0, after=("f",)))
    with pytest.raises(ValueError):
        j.order()
    with pytest.raises(ValueError):
        j.add(jobs.Job("g", lambda: 0))


def test_rows_come_from_a_database(spark, sf):
    url = "jdbc:derby:memory:tessera;create=true"
    properties = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    nation = spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", "n_name")
    nation.write.mode("overwrite").option("createTableColumnTypes", "n_name VARCHAR(64)").jdbc(url, "nation", properties=properties)
    want = sorted(tuple(r) for r in nation.where("n_nationkey >= 5").collect())
    query = 'SELECT "n_nationkey", "n_name" FROM nation WHERE "n_nationkey" >= 5'
    assert sorted(tuple(r) for r in ingest.from_database(spark, url, query, properties).collect()) == want
    parts = ingest.from_database(spark, url, query, properties, ("n_nationkey", 0, 25, 3))
    assert parts.rdd.getNumPartitions() == 3 and sorted(tuple(r) for r in parts.collect()) == want


def test_missing_columns_are_named(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert ingest.require_columns(df, "a", None, "*") is df
    with pytest.raises(ValueError, match="c, d"):
        ingest.require_columns(df, "a", "c", "d")
