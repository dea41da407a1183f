import hashlib
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import exact_dedup, near_dedup, quality

from .test_decontamination import distance, fold
from .test_near_dedup import brute as near_brute


def test_run_against_brute_force(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    scores = quality.quality_scores(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    left = sorted(r.doc_id for r in scores.collect() if r.predicted)
    assert len(left) < len(docs)
    groups = {}
    for d in left:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", docs[d].text), []).append(d)
    left = sorted(min(g, key=lambda d: (-len(docs[d].text), d)) for g in groups.values())
    left = [d for d, _, _, kept in near_brute([(d, docs[d].text) for d in left], 5, 80) if kept]
    items = [p for p in (fold(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()) if p]

    def leaks(text):
        words = fold(text)
        return any(set(p) & set(words) and distance(p, words)[0] <= len(p) // 5 for p in items if sum(x in set(words) for x in p) >= 0.8 * len(p))

    left = [d for d in left if not leaks(docs[d].text)]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d in sorted(left):
        ids = library.encode(docs[d].text, add_special_tokens=False).ids
        want.append((d, len(ids), ids, hashlib.sha256(docs[d].text.encode()).hexdigest()))
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want


ODD = [(None, "a b c d e f", "x", 1), (None, "a b c d e f", "y", 2), (None, None, "z", 3), (1, "one two", "p", 4), (1, "one  two", "q", 5), (1, "one  two", "q", 5), (2, "onetwo", "r", 6), (3, "", "s", 7), (4, " ", "t", 8)]


def test_stages_with_nulls_repeats_and_empty_tables(spark, sf):
    schema = "doc_id long, text string, kept string, _id int"
    docs = spark.createDataFrame(ODD, schema)
    got = sorted((r.doc_id, r.text) if r.doc_id else (0, r.text) for r in exact_dedup.without_copies(docs).collect())
    assert got == [(0, "a b c d e f"), (1, "one  two"), (4, " ")]
    near = near_dedup.one_of_each(docs).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in near) == sorted([(0, "a b c d e f"), (0, "a b c d e f"), (0, ""), (1, "one two"), (2, "onetwo"), (3, ""), (4, " ")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        clash = spark.createDataFrame(ODD, "doc_id long, text string, _hash string, _key int")
        clash = clash.withColumns({"_place": clash["_key"], "_row_key": clash["_key"], "_doc_key": clash["_key"], "_drop_id": clash["_key"]})
        got = stage(spark, clash, sf)
        assert got.columns == clash.columns and all(r["_place"] == r["_key"] for r in got.collect()), name
    for name, stage in corpus_pipeline.STAGES:
        frame = spark.createDataFrame([(d, t, k, i) for d, t, k, i in ODD], "doc_id long, text string, lang string, n_chars int")
        rows = stage(spark, frame, sf)
        assert rows.count() <= len(ODD), name
        if stage is not corpus_pipeline.token_ids:
            assert rows.columns == frame.columns
        assert stage(spark, frame.limit(0), sf).count() == 0


@pytest.mark.parametrize("without", [[], [0, 1]])
def test_classifier_stage_agrees_with_scores(spark, without):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where(f"not quality in ({','.join(map(str, without)) or 9})")
    want = {r.doc_id for r in quality.quality_scores(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in quality.only_good(docs, labels).collect()} == want
