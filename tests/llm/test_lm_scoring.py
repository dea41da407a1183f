import math
import random
import re
from collections import Counter

import pytest

from tessera.llm import lm_scoring as lm


def brute(texts, order, backoff=lm.BACKOFF):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    own = [Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) for w in split]
    count = sum(own, Counter())
    total = sum(map(len, split))

    def s(gram, k):
        c = lambda g: count[g] - own[k][g]
        others = total - len(split[k])
        if len(gram) == 1:
            return math.log(c(gram) / others) if c(gram) else math.log(backoff / (others + 1))
        return math.log(c(gram) / c(gram[:-1])) if c(gram) else math.log(backoff) + s(gram[1:], k)

    return [(len(w), sum(s(tuple(w[max(0, i - order + 1) : i + 1]), k) for i in range(len(w)))) for k, w in enumerate(split)]


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_against_brute_force(spark, order):
    rng = random.Random(order)
    texts = [None, "", " \t", "once", "é é é"] + [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(50))) for _ in range(60)]
    texts += ["the same"] * 9
    df = spark.createDataFrame([(i if i != 20 else None, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, bucket string, n_words int")
    got = {(20 if r.doc_id is None else r.doc_id): (r.n_words, r.log_score) for r in lm.scores(df, order=order, bucket_bytes=300).collect()}
    want = brute(texts, order)
    assert len(got) == len(texts)
    for i, (n, s) in enumerate(want):
        assert got[i][0] == n and got[i][1] == pytest.approx(s, abs=1e-9)


def test_texts_without_words(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "  ")], "doc_id long, text string")
    assert sorted(tuple(r) for r in lm.scores(df).collect()) == [(1, 0, 0.0), (2, 0, 0.0), (3, 0, 0.0)]


def test_empty_table(spark):
    assert lm.scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_ngram_counts(spark):
    texts = ["a b c a b", None, "", "a b"] + ["x y z"] * 300
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["count"] for r in lm.ngram_counts(df, 2, bucket_bytes=50).collect()) == [1, 1, 3, 300, 300]


def test_one_document_has_no_others(spark):
    df = spark.createDataFrame([(1, "a a b")], "doc_id long, text string")
    assert lm.scores(df).first().log_score == pytest.approx(brute(["a a b"], 3)[0][1])
