import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import decontamination as dc


def distance(pattern, text):
    """Sellers' table: the least distance to any stretch, and where the first such stretch ends."""
    row = list(range(len(pattern) + 1))
    best, end = row[-1], -1
    for j, x in enumerate(text):
        new = [0]
        for i, y in enumerate(pattern):
            new.append(min(row[i] + (x != y), row[i + 1] + 1, new[i] + 1))
        row = new
        if row[-1] < best:
            best, end = row[-1], j
    return best, end


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.lists(st.integers(0, 4), max_size=60))
def test_myers(pattern, text):
    assert dc.myers(np.array(pattern), np.array(text, np.int64)) == distance(pattern, text)


def fold(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(docs, items, errors=dc.ERRORS):
    out = []
    for d, t in docs:
        for i, x in items:
            p = fold(x)
            if p:
                n, end = distance(p, fold(t))
                if n <= dc.budget(len(p), errors):
                    out.append((d, i, n, len(p), end))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(6)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa é ü".split())
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 2, 5, 9, 10, 16, 40, 70])))) for i in range(14)] + [(50, None), (51, ""), (52, "?!"), (3, "Alpha, BETA alpha")]
    docs = [(1, None), (2, ""), (None, "É ü é"), (1, "alpha beta alpha")]
    for d in range(80):
        text = [word() for _ in range(rng.randrange(60))]
        p = fold(rng.choice(items)[1])
        for _ in range(rng.choice([0, 0, 1, 2, 9])):
            if p:
                k = rng.randrange(len(p))
                p[k : k + 1] = rng.choice([[], [word()], [p[k], word()]])
        at = rng.randrange(len(text) + 1)
        text[at:at] = p
        docs.append((100 + d, rng.choice([" ", ", ", "\n", " – "]).join(rng.choice([x, x.upper()]) for x in text)))
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, item_id string, distance int")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    for errors, size in ((0.2, 1 << 20), (0.2, 100), (0.0, 300)):
        got = sorted((tuple(r) for r in dc.contaminated(df, bench, errors=errors, block_bytes=size).collect()), key=repr)
        assert got == brute(docs, items, errors)
    rows = [(k, t) for k, (_, t) in enumerate(docs)]
    bad = {k for k, *_ in brute(rows, items)}
    for size in (1 << 20, 100):
        left = dc.without_contaminated(df, bench, block_bytes=size).collect()
        assert sorted(((r.doc_id, r.text) for r in left), key=repr) == sorted((docs[k] for k, _ in rows if k not in bad), key=repr)
    assert (1, None) in {(r.doc_id, r.text) for r in left} and (1, "alpha beta alpha") not in {(r.doc_id, r.text) for r in left}
    assert dc.contaminated(df.limit(0), bench).count() == dc.contaminated(df, bench.limit(0)).count() == 0


def test_query_finds_every_passage(spark):
    sf = "/root/testdata/sf0.01"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(r.doc_id, " ".join(fold(r.text))) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [tuple(r) for r in dc.op7_decontamination(spark, sf).collect()]
    exact = {(d, i) for i, x in items for d, t in docs if f" {' '.join(fold(x))} " in f" {t} "}
    assert exact and {(d, i) for d, i, n, *_ in got if n == 0} == exact
    texts, known = dict(docs), dict(items)
    assert all(distance(fold(known[i]), texts[d].split())[0] == n for d, i, n, *_ in got)
