"""Queries over ``documents`` and ``pages``: words, weights, chunks, postings and boolean search."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import bits as B
from tessera.functions import text as T
from tessera.operators import hybrid, postings, weights
from tessera.plans import sqlmini
from tessera.plans.catalogue import query
from tessera.plans.q_vector import embeddings
from tessera.sources.tables import table

_WORDS = r"w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\s\x0B]+')) AS word FROM documents)"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(
    "tokens",
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\s\x0B]+') AS w, regexp_extract_all(lower(text), '[^\s\x0B]+') AS l FROM documents)
    SELECT doc_id, len(w) AS n_words, len(list_distinct(l)) AS n_tokens FROM w""",
)
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir)
    return d.select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("n_words"), F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("term_freq", f"WITH {_WORDS} SELECT doc_id, word, count(*) AS n FROM w GROUP BY doc_id, word")
def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.term_counts(docs(spark, sf_dir))


@query(
    "tfidf_corpus",
    f"""WITH {_WORDS}, t AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY doc_id, word),
    l AS (SELECT doc_id, sum(n) AS len FROM t GROUP BY doc_id), df AS (SELECT word, count(*) AS df FROM t GROUP BY word),
    nd AS (SELECT count(*) AS docs FROM documents)
    SELECT t.doc_id, t.word, round(n / len * ln(docs / df), 6) AS weight FROM t JOIN l USING (doc_id) JOIN df USING (word), nd""",
)
def tfidf_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.tfidf(docs(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


_VOCABULARY = f"""{_WORDS}, c AS (SELECT word, count(DISTINCT doc_id) AS df, count(*) AS n FROM w GROUP BY word),
    v AS (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) - 1 AS slot FROM c ORDER BY n DESC, word LIMIT 1000)"""


@query("bow_vocabulary", f"WITH {_VOCABULARY} SELECT slot, word, n FROM v")
def bow_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.vocabulary(docs(spark, sf_dir), 1000)


@query("bow_vector", f"WITH {_VOCABULARY} SELECT doc_id, slot, count(*) AS n FROM w JOIN v USING (word) GROUP BY doc_id, slot")
def bow_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weights.bag_of_words(docs(spark, sf_dir), 1000)


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(
    "clean_text",
    rf"""SELECT doc_id, md5(array_to_string(list_filter(string_split(regexp_replace(text, '[\s\x0B\pP]+', ' ', 'g'), ' '),
    lambda w: w <> '' AND NOT list_contains([{_STOP}], w)), ' ')) AS cleaned FROM documents""",
)
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.md5(T.clean(F.col("text")).cast("binary")).alias("cleaned"))


@query(
    "chunk_text",
    r"""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[^\s\x0B]+'), lambda x: {'n': 1, 's': strlen(x)}) AS w FROM documents),
    r AS (SELECT doc_id, list_reduce(w, lambda a, x: {'n': a.n + (CASE WHEN a.s + x.s > 512 THEN 1 ELSE 0 END), 's': CASE WHEN a.s + x.s > 512 THEN x.s ELSE a.s + x.s END}) AS r
          FROM w WHERE len(w) > 0)
    SELECT doc_id, CAST(r.n AS BIGINT) AS n_chunks, CAST(r.s AS BIGINT) AS last_size FROM r""",
)
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Behind a generator the fold runs once, whatever reads its result.
    c = docs(spark, sf_dir).select("doc_id", F.explode(F.array(T.chunks(F.col("text")))).alias("c")).where("size(c) > 0")
    last = F.replace(F.element_at("c", -1), F.lit(" "), F.lit(""))
    return c.select("doc_id", F.size("c").cast("long").alias("n_chunks"), F.octet_length(last).cast("long").alias("last_size"))


@query(
    "chunk_rows",
    r"""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[^\s\x0B]+'), lambda x: {'done': CAST([] AS VARCHAR[]), 'open': x, 'size': strlen(x)}) AS w FROM documents),
    r AS (SELECT doc_id, list_reduce(w, lambda a, x: CASE WHEN a.size + x.size > 512 THEN {'done': list_append(a.done, a.open), 'open': x.open, 'size': x.size}
          ELSE {'done': a.done, 'open': a.open || ' ' || x.open, 'size': a.size + x.size} END) AS r FROM w WHERE len(w) > 0),
    c AS (SELECT doc_id, list_append(r.done, r.open) AS c FROM r),
    u AS (SELECT doc_id, len(c) AS total, unnest(range(len(c))) AS chunk, unnest(c) AS text FROM c)
    SELECT doc_id, CAST(total AS INTEGER) AS total, CAST(chunk AS INTEGER) AS chunk, text, doc_id || '_chunk_' || chunk AS chunk_id FROM u""",
)
def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk with its id, place and number of chunks."""
    c = docs(spark, sf_dir).select("doc_id", F.explode(F.array(T.chunks(F.col("text")))).alias("c"))
    return c.select("doc_id", F.size("c").alias("total"), F.posexplode("c").alias("chunk", "text")).withColumn(
        "chunk_id", F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("chunk").cast("string"))
    )


@query("token_estimate", "SELECT doc_id, CAST(floor(length(text) / 2) AS BIGINT) AS estimate FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", T.token_estimate(F.col("text")).cast("long").alias("estimate"))


@query("distinct_characters", "SELECT doc_id, len(list_distinct(string_split(text, ''))) AS n FROM documents WHERE length(text) > 0")
def distinct_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).where(F.length("text") > 0)
    return d.select("doc_id", F.size(T.characters(F.col("text"))).cast("long").alias("n"))


_HTML = r"""regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g')"""
_HTML = rf"regexp_replace({_HTML}, '(?s)<!--.*?-->|<[^>]*>', ' ', 'g')"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_a}', '{_b}')"


@query("html_text", rf"SELECT page_id, md5(trim(regexp_replace({_HTML}, '[\s\x0B]+', ' ', 'g'))) AS text FROM pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.html_text(F.col("html")).cast("binary")).alias("text"))


# -- postings: the mask has a bit for the language and one for the first source

_BITS = "(CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 4 WHEN 'es' THEN 8 ELSE 0 END) + (CASE WHEN source = 'src0' THEN 16 ELSE 0 END)"
_POSTINGS = rf"p AS (SELECT DISTINCT doc_id, CAST({_BITS} AS BIGINT) AS bits, unnest(regexp_extract_all(lower(text), '[^\s\x0B]+')) AS word FROM documents)"


def _postings(spark: SparkSession, sf_dir: str, only: Iterable[str] | None = None) -> DataFrame:
    return postings.build(docs(spark, sf_dir), {"text": "body"}, bits=F.expr(f"cast({_BITS} as bigint)"), only=only)


@query("postings", f"WITH {_POSTINGS} SELECT doc_id, 'body' AS field, word, bits FROM p")
def postings_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _postings(spark, sf_dir)


def _word(w: str) -> postings.Term:
    return postings.Term("body", w)


def _has(w: str) -> str:
    return f"bool_or(word = '{w}')"


def _boolean(name: str, term: postings.Term, having: str, where: str = "", on: int = 0, off: int = 0, any_of: tuple[int, ...] = ()) -> None:
    keys = ", ".join(f"'{w}'" for _, w in sorted(term.keywords()))

    @query(name, f"WITH {_POSTINGS} SELECT doc_id FROM p WHERE word IN ({keys}) {where} GROUP BY doc_id HAVING {having}")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return postings.search(_postings(spark, sf_dir, [w for _, w in term.keywords()]), term, on, off, any_of)


_boolean("kw_and", _word("the").also(_word("of"), _word("with")), f"{_has('the')} AND {_has('of')} AND {_has('with')}")
_boolean("kw_or", _word("der").either(_word("que"), _word("les")), f"{_has('der')} OR {_has('que')} OR {_has('les')}")
_boolean("kw_nested", _word("the").also(_word("with").either(_word("from"), _word("by").also(_word("at")))), f"{_has('the')} AND ({_has('with')} OR {_has('from')} OR ({_has('by')} AND {_has('at')}))")
_boolean("kw_unknown", _word("the").also(_word("no-such-word")), f"{_has('the')} AND {_has('no-such-word')}")
_boolean("bit_filter", _word("de"), _has("de"), "AND (bits & 16) = 16 AND (bits & 2) = 0 AND (bits & 12) <> 0", 16, 2, (12,))


@query("field_bits", f"SELECT doc_id, CAST({_BITS} AS BIGINT) AS bits, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE -1 END AS position FROM documents")
def field_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = B.position(F.lit("lang"), F.col("lang"), {("lang", "en"): 0, ("lang", "fr"): 1})
    return docs(spark, sf_dir).select("doc_id", F.expr(f"cast({_BITS} as bigint)").alias("bits"), at.alias("position"))


_SEARCH = ["the", "with", "from", "der", "que"]
_HITS = f"h AS (SELECT doc_id, count(DISTINCT word) AS n_hits FROM p WHERE word IN ({', '.join(repr(w) for w in _SEARCH)}) GROUP BY doc_id)"


@query(
    "kw_count_rank",
    f"""WITH {_POSTINGS}, {_HITS}, s AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id)
    SELECT doc_id, n_hits, round(n_hits / n, 6) AS similarity FROM h JOIN s USING (doc_id)""",
)
def kw_count_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _postings(spark, sf_dir)
    sizes = p.groupBy("doc_id").agg(F.count("*").alias("n"))
    return postings.hits(p, _SEARCH).join(sizes, "doc_id").withColumn("similarity", F.round(F.col("n_hits") / F.col("n"), 6)).drop("n")


@query(
    "kw_vector_fallback",
    f"""WITH {_POSTINGS}, {_HITS}, e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v AS q FROM e WHERE vec_id = 0),
    n AS (SELECT vec_id AS doc_id, 1 - list_cosine_similarity(v, q) AS d FROM e, q ORDER BY d, vec_id LIMIT 30)
    SELECT doc_id, round(d, 6) AS distance FROM n WHERE doc_id IN (SELECT doc_id FROM h WHERE n_hits >= 2)""",
)
def kw_vector_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators import knn
    from tessera.plans.q_vector import vector

    e = embeddings(spark, sf_dir)
    near = knn.nearest(e, vector(e), 30).select("id", "distance")
    words = postings.hits(_postings(spark, sf_dir, _SEARCH), _SEARCH).where("n_hits >= 2").select(F.col("doc_id").alias("id"))
    return hybrid.with_fallback(near, words).select(F.col("id").alias("doc_id"), F.round("distance", 6).alias("distance"))


@query(
    "doc_by_score_id",
    rf"""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS score_id, text FROM documents)
    SELECT doc_id, score_id, len(list_distinct(regexp_extract_all(lower(text), '[^\s\x0B]+'))) AS n_keywords FROM d WHERE score_id = 7""",
)
def doc_by_score_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.sources.store import with_score_ids

    numbered = with_score_ids(docs(spark, sf_dir).select("doc_id"), "doc_id")
    found = postings.by_score_id(_postings(spark, sf_dir), numbered, 7)
    return found.select("doc_id", F.col("score_id").cast("long"), F.size("keywords").cast("long").alias("n_keywords"))


@query(
    "embedding_of_text",
    f"""WITH {_WORDS}, t AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY doc_id, word),
    x AS (SELECT doc_id, n, length(word) AS a, strlen(word) AS b FROM t),
    m AS (SELECT doc_id, sum(a * n) / sum(n) AS a, sum(b * n) / sum(n) AS b FROM x GROUP BY doc_id)
    SELECT doc_id, round(a, 6) AS first, round(b, 6) AS second, round(a / sqrt(a * a + b * b), 6) AS unit FROM m""",
)
def embedding_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as weighted means of word vectors; a word's vector here is its length in characters and bytes."""
    from tessera.functions import vectors as V

    d = docs(spark, sf_dir)
    words = weights.term_counts(d).select("word").distinct()
    known = words.withColumn("vec", F.array(F.length("word").cast("double"), F.octet_length("word").cast("double")))
    m = weights.mean_embedding(d, known).withColumn("unit", V.normalize(F.col("vec")))
    return m.select("doc_id", *[F.round(F.get(c, i), 6).alias(n) for c, i, n in (("vec", 0, "first"), ("vec", 1, "second"), ("unit", 0, "unit"))])


@query("mini_select", "SELECT doc_id, lang AS l, n_chars FROM documents WHERE (lang = 'fr' OR lang = 'de') AND n_chars >= 1000 AND NOT source LIKE 'src1%' ORDER BY n_chars DESC, doc_id LIMIT 40 OFFSET 5")
def mini_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "select doc_id, lang as l, n_chars from docs where (lang = 'fr' or lang = 'de') and n_chars >= 1000 and not source like 'src1%' order by n_chars desc, doc_id limit 40 offset 5"
    return sqlmini.execute(text, {"docs": docs(spark, sf_dir)})


@query("mini_search", f"WITH {_POSTINGS} SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM p WHERE word = 'with') AND lang IN ('en', 'fr')")
def mini_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _postings(spark, sf_dir)
    found = lambda w: postings.search(p, _word(w))
    return sqlmini.execute("SELECT doc_id, lang FROM docs WHERE _keyword_ = 'with' AND lang IN ('en', 'fr')", {"docs": docs(spark, sf_dir)}, keyword=found)


@query(
    "search_sql",
    f"""WITH {_POSTINGS}, e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v AS q FROM e WHERE vec_id = 3),
    n AS (SELECT vec_id AS doc_id, 1 - list_cosine_similarity(v, q) AS d FROM e, q ORDER BY d, vec_id LIMIT 60),
    h AS (SELECT doc_id FROM p WHERE word IN ('the', 'of') AND (bits & 1) = 1 AND (bits & 16) = 0 GROUP BY doc_id HAVING count(DISTINCT word) = 2)
    SELECT doc_id, round(d, 6) AS distance FROM n WHERE doc_id IN (SELECT doc_id FROM h) ORDER BY d, doc_id LIMIT 10 OFFSET 2""",
)
def search_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search for words near vector 3, in English and not from the first source."""
    from tessera.operators import search
    from tessera.plans.q_vector import vector

    e = embeddings(spark, sf_dir)
    q = sqlmini.parse_search("SELECT * FROM docs WHERE keyword='the of' AND vector_query='3' AND k=60 AND on_flag=1 AND off_flag=16 LIMIT 10 OFFSET 2")
    d = docs(spark, sf_dir).withColumn("bits", F.expr(f"cast({_BITS} as bigint)"))
    found = search.run(q, d, _postings(spark, sf_dir), e.withColumnRenamed("id", "doc_id"), lambda text, _: vector(e, int(text)))
    return found.select("doc_id", F.round("distance", 6).alias("distance"))


@query("prefix_words", f"WITH {_POSTINGS} SELECT DISTINCT word FROM p WHERE starts_with(word, 'thing')")
def prefix_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.with_prefix(_postings(spark, sf_dir), "thing")


@query("keyword_ranges", f"WITH {_POSTINGS} SELECT word, count(*) AS n FROM p WHERE word BETWEEN 'a' AND 'b' GROUP BY word")
def keyword_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.versions import range_scan

    return range_scan(_postings(spark, sf_dir), "word", "a", "b").groupBy("word").agg(F.count("*").alias("n"))


@query("first_of_each_source", "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def first_of_each_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy("doc_id")
    return docs(spark, sf_dir).withColumn("k", F.row_number().over(w)).where("k = 1").select("source", "doc_id")
