import random
import re

import pyarrow as pa

from tessera.llm import words

TEXTS = [None, "", "  ", "one", " two  words\n", "a b c d e f", "é ü\x0bx\x0cy", "x" * 300_000 + " y", "Ab aB AB", "z z z z z z z z", "last "]


def test_words_numbers_and_grams_follow_the_text():
    rng = random.Random(1)
    texts = [*TEXTS, *(" ".join(rng.choice("abcde") for _ in range(rng.randrange(40))) for _ in range(50))]
    for column in (pa.array(texts), pa.array([None, "skipped words", *texts]).slice(2), pa.array(texts, pa.large_string())):
        w = words.split(column)
        want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
        got = [bytes(w.data[a:b]).decode() for a, b in zip(w.starts, w.ends, strict=True)]
        assert got == sum(want, []) and w.counts().tolist() == list(map(len, want))
        number = words.numbers(w)
        of = {}
        assert all(of.setdefault(x, n) == n for x, n in zip(got, number.tolist(), strict=True)) and len(set(of.values())) == len(of)
        for n in (1, 2, 3, 5, 7):
            gram, at = words.grams(number, w, n)
            flat = [tuple(x[i : i + n]) for x in want for i in range(len(x) - n + 1)]
            assert len(gram) == len(flat) == len(at)
            of = {}
            assert all(of.setdefault(x, g) == g for x, g in zip(flat, gram.tolist(), strict=True)) and len(set(of.values())) == len(of)


def test_lower_case_is_ascii_only():
    w = words.split(pa.array(["Ab aB ÀB àb"]), lower=True)
    a, b, c, d = words.numbers(w).tolist()
    assert a == b and c != d


def test_empty_column():
    w = words.split(pa.array([], pa.string()))
    assert len(words.numbers(w)) == 0 and w.counts().tolist() == []
