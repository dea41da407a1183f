"""The whole query against a second computation, word by word."""

import math
import re
import zlib

import numpy as np

from tessera.llm import quality as q


def measured(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    raw = (text or "").encode()
    shouts = sum(len(re.findall("[A-Z]", w)) > 1 and not re.search("[a-z0-9]", w) for w in words)
    per = lambda chars: math.sqrt(sum(raw.count(c.encode()) for c in chars) / max(len(raw), 1))
    poverty = 1 - math.log(len(set(words))) / math.log(len(words)) if len(words) > 1 else 0
    again = sum(a == b for a, b in zip(words, words[1:]))
    n = max(len(words), 1)
    return [math.sqrt(shouts / n), per("!"), per("#$%&*+<=>[\\]^`{|}~"), poverty, math.sqrt(again / n)]


def test_scores_of_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: measured(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    known = [i for i in labels if i in docs and not held(i)]
    x = np.array([docs[i] for i in known])
    y = np.array([labels[i] for i in known])
    own = [np.cov(x[y == k].T) for k in (0, 1)]
    n = [int((y == k).sum()) for k in (0, 1)]
    pooled = sum((m - 1) * c for m, c in zip(n, own)) / (len(y) - 2)
    density = []
    for k in (0, 1):
        cov = 0.5 * own[k] + 0.5 * pooled
        cov = 0.9 * cov + 0.1 * max(np.trace(cov) / 5, 1e-9) * np.eye(5)
        mean, inverse, log_det = x[y == k].mean(axis=0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
        density.append(lambda v, m=mean, i=inverse, d=log_det, p=n[k] / len(y): math.log(p) - 0.5 * d - 0.5 * (v - m) @ i @ (v - m))
    got = q.op5_quality_classifier(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        v = np.array(docs[r.doc_id])
        gap = (density[1](v) - density[0](v)) / 5
        score = 1 / (1 + math.exp(-max(-700, min(700, gap))))
        assert abs(r.score - score) < 1e-6 and r.held_out == held(r.doc_id) and r.predicted == (r.score >= 0.3)


def test_texts_that_are_no_strings_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, 12345), (1, 12345), (None, None)], "doc_id long, text long")
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, quality int")
    assert q.only_good(docs, labels).count() == 3
    both = spark.createDataFrame([(i, "Plain words stand here, as they do in a book." if i % 2 else "BUY!!! $$$ BUY!!! BUY!!! ###") for i in range(60)], "doc_id long, text string")
    truth = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    assert {r.doc_id % 2 for r in q.only_good(both, truth).collect()} == {1}
    assert q.only_good(docs, truth.join(both, "doc_id").select("doc_id", "quality")).count() == 3
