import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute

from tessera.llm import exchange
from tessera.llm import substring_dedup as sd


def brute(texts, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghijklmnopqrst")
    passages = [[word() for _ in range(rng.randrange(4, 30))] for _ in range(6)]
    texts = [None, "", " \n", "a", "é " * 40]
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts += rng.choice(passages) if rng.random() < 0.5 else [rng.choice("xyz") if rng.random() < 0.3 else word() for _ in range(rng.randrange(12))]
        texts.append(rng.choice([" ", "  ", "\n", "\t"]).join(parts))
    texts.append(" ".join(["und"] * 30 + ["x"] + ["a", "b", "c"] * 9))
    df = spark.createDataFrame([(i if i % 17 else None, t, "clash", i) for i, t in enumerate(texts)], "doc_id long, text string, bucket string, n_words int")
    for window, anchor in ((8, 3), (5, 5), (6, 1)):
        got = sd.without_repeats(df, window=window, anchor_words=anchor, bucket_bytes=700).collect()
        assert Counter((r.n_words, r.n_removed, r.text) for r in got) == Counter(brute(texts, window))
        assert all(f.n >= window for r in got for f in r.factors)
        assert sum(r.doc_id is None for r in got) == sum(i % 17 == 0 for i in range(len(texts)))


def test_texts_without_words(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  ")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in sd.without_repeats(df).collect()) == [(i, 0, 0, "") for i in (1, 2, 3)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sd.without_repeats(df).collect() == []


def test_query_over_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = sorted((d.doc_id, n, gone, hashlib.sha256(t.encode()).hexdigest()) for d, (n, gone, t) in zip(docs, brute([d.text for d in docs], 35), strict=True))
    assert sorted(tuple(r) for r in sd.op8_substring_dedup(spark, sf).collect()) == want
    assert sum(w[2] for w in want) > 0


def test_factors_are_phrases_of_their_sources():
    rng = random.Random(8)
    word = lambda: rng.choice("abcd")
    passages = [[word() for _ in range(12)] for _ in range(4)]
    blocks = [[" ".join(w for _ in range(6) for w in (rng.choice(passages) if rng.random() < 0.5 else [word() for _ in range(5)])) for _ in range(5)] for _ in range(3)]
    parsed = [sd.parse(pa.array(b), 6, 2) for b in blocks]
    requests = exchange.requests_table([r for k, p in enumerate(parsed) for r in sd._asked(k, p.window, p.at, 1)])
    replies = sd._first_elsewhere(requests)
    flat = [[w for t in b for w in t.split()] for b in blocks]
    for k, p in enumerate(parsed):
        keys, of = np.unique(p.window, return_inverse=True)
        elsewhere = exchange.totals_of(replies.filter(pa.compute.equal(replies["bucket"], k)), sd._WINDOWS, np.uint64, sd._from_sources, keys, 1)
        source = sd.sources(p.at, k, elsewhere, of)
        # Brute force: the first place of all others, block by block.
        every = [(b, int(i), int(w)) for b, q in enumerate(parsed) for i, w in zip(q.at, q.window, strict=True)]
        for i, w, got in zip(p.at.tolist(), p.window.tolist(), source.tolist(), strict=True):
            want = min(((b, j) for b, j, x in every if x == w and (b, j) != (k, i)), default=None)
            assert got == (int(sd.NOWHERE) if want is None else want[0] << 32 | want[1])
        _, first, n, source = sd.factors(source, p.at, p.words.owner(), 6)
        for a, m, q in zip(first.tolist(), n.tolist(), source.tolist(), strict=True):
            there = flat[q >> 32][q & 0xFFFFFFFF :][:m]
            assert m >= 6 and flat[k][a : a + m] == there and (q >> 32, q & 0xFFFFFFFF) != (k, a)


def test_long_and_heavily_repeated_rows(spark):
    long_ = " ".join(f"w{i % 700}" for i in range(60_000))
    rows = [(1, long_), (2, " ".join(f"u{i}" for i in range(200)))] + [(3, "p q r s t u v w")] * 400 + [(None, None)] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sd.without_repeats(df, window=8, anchor_words=3, bucket_bytes=5000).collect()
    assert Counter((r.n_words, r.n_removed, r.text) for r in got) == Counter(brute([t for _, t in rows], 8))
