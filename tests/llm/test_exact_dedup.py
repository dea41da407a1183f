import hashlib
import re
from collections import Counter

import pytest

from tessera.llm import exact_dedup as ed


def brute(rows):
    groups = {}
    for i, (d, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d is None, d or 0, i))
    out = []
    for key, members in groups.items():
        best = min(members)
        for m in members:
            out.append((rows[m[3]][0], rows[best[3]][0], len(members), m[:3] == best[:3], hashlib.sha256(key.encode()).hexdigest()))
    return out


def check(got, rows, digest):
    """Exactly one row of each group stays; repeated rows with the keeper's id are told apart only by that."""
    want = brute(rows)
    trim = lambda r, k: tuple(r)[:3] + ((r[4],) if digest else ())
    assert Counter(trim(r, 0) for r in got) == Counter(trim(r, 0) for r in want)
    assert sum(r[3] for r in got) == len({r[4] for r in want})
    for r in got:
        if r[3]:
            assert r[0] == r[1]


ROWS = [
    (1, "a b"), (2, "ab"), (3, "a  b"), (4, "a  b"), (5, None), (6, ""), (7, " \n\x0b"), (8, "a b"), (9, "A b"), (None, "z z"), (None, "zz"), (10, "zz"),
    (11, "x" * 5000 + "1"), (12, "x" * 5000 + "2"), (13, "x" * 5000 + " 1"), (14, "only"), (15, "é"), (16, "é"), (1, "a b"), (3, "a  b"),
]


@pytest.mark.parametrize("digest", [True, False])
def test_against_brute_force(spark, digest):
    df = spark.createDataFrame([(d, t, "x", 9, True) for d, t in ROWS], "doc_id long, text string, keep_id string, _len int, kept boolean")
    got = ed.exact_dedup(df, with_digest=digest).collect()
    check(got, ROWS, digest)
    if not digest:
        assert all(r.text_hash is None or r.group_size >= 1 for r in got) and any(r.text_hash is None for r in got)
    assert ed.exact_dedup(df.limit(0), with_digest=digest).count() == 0


def test_string_ids(spark):
    df = spark.createDataFrame([("b", "t"), ("a", "t"), ("c", "u")], "key string, body string")
    got = sorted(tuple(r)[:4] for r in ed.exact_dedup(df, "key", "body").collect())
    assert got == [("a", "a", 2, True), ("b", "a", 2, False), ("c", "c", 1, True)]


def test_rows_that_stay(spark):
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(ROWS)], "doc_id long, text string, kept int")
    got = ed.without_copies(df).collect()
    assert got and set(got[0].asDict()) == {"doc_id", "text", "kept"}
    squeezed = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in got]
    assert len(squeezed) == len(set(squeezed)) == len({r[4] for r in brute(ROWS)})
    keepers = {r[4]: r[1] for r in brute(ROWS)}
    assert all(keepers[hashlib.sha256(s.encode()).hexdigest()] == r.doc_id for s, r in zip(squeezed, got, strict=True))


def test_query_over_the_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = ed.op10_exact_dedup(spark, sf).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute(rows))


def test_plan_is_native(spark, sf):
    plan = ed.op10_exact_dedup(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
