import random
import re

import numpy as np

from tessera.llm import near_dedup as nd


def brute(rows, n, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in where[x] if j < i}:
            if 100 * len(s & sets[j]) >= percent * len(s | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    comp = [least.get(find(i)) if sets[i] else rows[i][0] for i in range(len(rows))]
    return sorted(((d, len(s), c, d == c) for (d, _), s, c in zip(rows, sets, comp, strict=True)), key=repr)


def _made(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one  two"), (8, "é É"), (9, "é É"), (10, "Two one"), (11, "")]
    for base in range(30):
        w = [word() for _ in range(rng.choice([4, 8, 30, 120]))]
        for _ in range(rng.choice([1, 2, 6, 20])):
            v = list(w)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                v[rng.randrange(len(v))] = word()
            rows.append((100 + len(rows), rng.choice([" ", "\n"]).join(v)))
    rng.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    for n, percent in ((3, 85), (5, 80)):
        rows = _made(n)
        df = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, component_id string, _node int")
        got = sorted((tuple(r) for r in nd.near_duplicates(df, shingle_words=n, percent=percent).collect()), key=repr)
        assert got == brute(rows, n, percent)


def test_long_postings_go_block_by_block(spark):
    rows = _made(9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in nd.near_duplicates(df, shingle_words=3, percent=85, block=3).collect()), key=repr)
    assert got == brute(rows, 3, 85)


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (None, "x y z"), (7, "a b c d"), (7, "q r s t"), (7, "a b c d"), (9, "q r s t"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.component_id) for r in nd.near_duplicates(df, shingle_words=3).collect()]
    assert sorted(got, key=repr) == sorted([(None, 7), (None, 7), (None, None), (7, 7), (7, 7), (7, 7), (9, 7), (None, None)], key=repr)
    assert nd.near_duplicates(df.limit(0)).count() == 0


def test_query_over_the_whole_table(spark, sf):
    rows = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in nd.op9_minhash_near_dedup(spark, sf).collect()), key=repr)
    assert got == brute(rows, 3, 85)


def _drifting(seed, n, words, step):
    """Each text is the one before with some words changed: linked as a chain, far apart at its ends."""
    rng = random.Random(seed)
    w = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        for _ in range(step):
            w[rng.randrange(words)] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_chains_and_hot_passages_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "PIVOTS", 1)
    passage = " ".join(f"p{i}" for i in range(150))
    texts = _drifting(1, 60, 120, 1) + _drifting(2, 40, 60, 1) + [f"{passage} {t}" for t in _drifting(3, 40, 40, 12)] + _drifting(4, 20, 30, 9)
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (4, 1024):
        got = sorted((tuple(r) for r in nd.near_duplicates(df, shingle_words=3, percent=85, block=block).collect()), key=repr)
        assert got == brute(rows, 3, 85)


def test_long_texts_are_blocks_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK_BYTES", 200_000)
    base = " ".join(f"v{i}" for i in range(40_000))
    rows = [(i, base + f" end{i}" * (i % 3)) for i in range(8)] + [(50, "short text of few words"), (51, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in nd.near_duplicates(df, shingle_words=3, percent=85).collect()), key=repr)
    assert got == brute(rows, 3, 85)


def test_partners_are_those_of_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(40):
        m = int(rng.integers(2, 30))
        group = np.sort(rng.integers(0, 4, m))
        sig = rng.integers(0, 2, (m, nd.COORDINATES)).astype(np.int32)
        coordinate = group % 5
        sig[:, :5] = np.where(np.arange(5)[None, :] == coordinate[:, None], 7, sig[:, :5])
        prefix = rng.random((m, nd.COORDINATES)) < 0.2
        prefix[np.arange(m), coordinate] = True
        apart = rng.integers(0, 3, m) if rng.random() < 0.5 else np.full(m, -1)
        want = np.zeros(m, bool)
        for i in range(m):
            for j in range(m):
                same = sig[i] == sig[j]
                first = (same & prefix[i] & prefix[j]).argmax() == coordinate[i]
                want[i] |= i != j and group[i] == group[j] and same.sum() >= 33 and first and (apart[i] < 0 or apart[i] != apart[j])
        assert (nd.partnered(group, coordinate, sig, prefix, apart, 33) == want).all()
