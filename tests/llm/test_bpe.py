import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe, bpe_codec, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
VOCABULARY = bpe.load("byte_bpe_50k.json")
HARD = [
    "", " ", "\n\n  \t x", "a" * 5000, "ab" * 3000, "don't I'LL we'll 's't", "x<|endoftext|>y <|endoftext|>", "naïve café ééé ½ ²³ 你好世界 😀😀👍🏽",
    "՘֋ text ౜ \U00010ec5", "é" * 700, "=" * 1201, "tab\tand nbsp em", "1234567890" * 90, "\x00\x01\x1c\x1f\x85",
]


def _random_runs():
    rng = random.Random(5)
    for alphabet in ("ab", "abcdefghijklmnopqrstuvwxyz", "theinro", "éèà你"):
        for n in (300, 1100, 4097):
            yield "".join(rng.choice(alphabet) for _ in range(n))


def encode(texts, memory=None):
    ids, offsets = (memory or bpe.Memory(VOCABULARY, bpe_codec.encoder(VOCABULARY))).ids(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]


def count(texts, memory=None):
    return (memory or bpe.Memory(VOCABULARY)).counts(pa.array(texts, pa.string())).tolist()


def decode(ids):
    return VOCABULARY.decode(np.array(ids, np.int64), np.array([0, len(ids)])).to_pylist()[0]


@pytest.mark.parametrize("text", [*HARD, *_random_runs()])
def test_ids_and_counts_are_the_librarys(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert encode([text]) == [want]
    assert count([text, text]) == [len(want)] * 2
    assert decode(want) == LIBRARY.decode(want, skip_special_tokens=False) == text


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert encode([text]) == [want]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abtheing", min_size=2, max_size=400))
def test_small_leaves_and_windows(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert bpe_codec.encode_runs([text.encode()], VOCABULARY, leaf=3, window=1) == [want]


def test_remembered_tokens_may_run_out(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    known, counted = bpe.Memory(VOCABULARY, bpe_codec.encoder(VOCABULARY)), bpe.Memory(VOCABULARY)
    for text in ("one two three", "four five six seven", "one two eight", "<|endoftext|>"):
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        assert count([text], counted) == [len(want)]
        assert encode([text], known) == [want]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int, n_tokens int, _text string")


def test_frames_with_nulls_clashes_and_repeats(spark):
    rows = [(1, "hello world", "x", 1, 2, "y"), (None, None, None, None, None, None), (2, "", "x", 1, 2, "y"), (1, "hello world", "x", 1, 2, "y")]
    df = _frame(spark, rows)
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(df).collect()))
    assert got == [(0, 0, 0), (1, 11, 2), (1, 11, 2), (2, 0, 0)]
    done = bpe_codec.bpe_codec(df)
    assert sorted((r.doc_id or 0, r.ids, r.decoded) for r in done.collect()) == [(0, [], ""), (1, [31373, 995], "hello world"), (1, [31373, 995], "hello world"), (2, [], "")]
    assert sorted(r.text for r in bpe_codec.bpe_decode(done).collect()) == ["", "", "hello world", "hello world"]
    assert token_counts.token_counts(df.limit(0)).count() == 0 and bpe_codec.bpe_codec(df.limit(0)).count() == 0


def test_queries_over_the_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    ids = {d.doc_id: LIBRARY.encode(d.text, add_special_tokens=False).ids for d in docs}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((d.doc_id, len(ids[d.doc_id]), sha(",".join(map(str, ids[d.doc_id]))), sha(d.text)) for d in docs)
    assert sorted(tuple(r) for r in bpe_codec.op4_bpe_codec(spark, sf).collect()) == want
    want = sorted((d.doc_id, len(d.text.encode()), len(ids[d.doc_id]), len(ids[d.doc_id]) > 1024) for d in docs)
    assert sorted(tuple(r) for r in token_counts.op3_token_counts(spark, sf).collect()) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="a'sdtremvl \n\t1!é\u00a0<|endoftext|>\U00010ec5", max_size=14), max_size=5))
def test_texts_of_spaces_apostrophes_and_specials(texts):
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert encode(texts) == want and count(texts) == list(map(len, want))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="a'st é<|endoftext|>", min_size=20, max_size=80), st.integers(1, 12))
def test_long_texts_come_in_stretches(text, limit):
    parts = list(bpe.stretches(pa.array(["x", text, None, "y"]), limit))
    got = ["" for _ in range(4)]
    for first, some in parts:
        for i, x in enumerate(some.cast(pa.large_binary()).to_pylist()):
            got[first + i] += (x or b"").decode()
    assert got == ["x", text, "", "y"]
    ids = [i for first, some in parts if first == 1 and len(some) == 1 for i in bpe.Memory(VOCABULARY).ids(some)[0].tolist()]
    assert not ids or "<|" in text or ids == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("alphabet", ["ab", "etaoinshr", "x"])
def test_a_very_long_run_is_merged_by_rank(alphabet):
    text = "".join(random.Random(3).choices(alphabet, k=300_000))
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert count([text]) == [len(want)]
    assert encode([text]) == [want]


def test_ids_that_are_no_utf8_are_replaced():
    ids = LIBRARY.encode("é", add_special_tokens=False).ids + LIBRARY.encode("你", add_special_tokens=False).ids[:1]
    assert decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)
