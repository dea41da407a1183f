import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import bits, lsh, text
from tessera.functions import vectors as V


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_cosine(spark):
    assert value(spark, V.cosine([1, 2, 3], [4, 5, 6])) == pytest.approx(0.974631846, abs=1e-9)
    assert value(spark, V.cosine([0, 0, 0], [4, 5, 6])) == 0
    assert value(spark, V.cosine([1, 2], [4, 5, 6], mismatch=-1.0)) == -1
    assert value(spark, V.cosine([1, 2], [4, 5, 6])) is None


def test_distances(spark):
    a, b = [1.0, 2.0, 3.0], [4.0, 6.0, 3.0]
    assert value(spark, V.distance(a, b, 0)) == 5 and value(spark, V.distance(a, b, "l2_squared")) == 25
    assert value(spark, V.distance(a, b, 3)) == 7 and value(spark, V.distance(a, b, 2)) == -25
    assert value(spark, V.distance(a, a, 1)) == pytest.approx(0)
    assert value(spark, V.l2([1], b)) is None and value(spark, V.dot(F.lit(None).cast("array<double>"), b)) is None
    with pytest.raises(ValueError):
        V.distance(a, b, 9)


def test_normalize(spark):
    assert value(spark, V.normalize([3, 4])) == pytest.approx([0.6, 0.8])
    assert value(spark, V.normalize([0, 0])) == [0, 0]
    assert value(spark, V.normalize([0, 5])) == [0, 1]


def test_quantize_and_bounds(spark):
    assert value(spark, V.quantize([0.0, 0.4, 0.6, 1.0], F.lit(0.0), F.lit(1.0), 1)) == [0, 0, 1, 1]
    assert value(spark, V.quantize([2.0, 2.0], F.lit(2.0), F.lit(2.0), 8)) == [2, 2]
    assert value(spark, V.within_norms([3, 4], 5, 5)) and not value(spark, V.within_norms([3, 4], 6))
    assert not value(spark, V.within_norms([0, 0])) and value(spark, V.within_norms([0, 0], drop_zero=False))
    with pytest.raises(ValueError):
        V.parts([1, 2, 3], 2, 3)


def test_hashes_of_vectors_and_strings(spark):
    assert value(spark, V.cache_key([1.0, 0.5], 10)) == value(spark, V.cache_key([1.0000001, 0.5], 10)) != value(spark, V.cache_key([1.0, 0.5], 11))
    want = 0
    for c in "hello":
        want = (want * 31 + ord(c)) % (2**31 - 1)
    assert value(spark, V.poly_hash(F.lit("hello"))) == want
    assert value(spark, V.vector_hash([1.0])) != value(spark, V.vector_hash([2.0]))


def test_bits(spark):
    for mask, ok in ((0b0111, True), (0b0011, False), (0b1111, False), (0b0110, False)):
        assert value(spark, bits.passes(F.lit(mask), 0b0001, 0b1000, (0b0100, 0))) == ok
    assert value(spark, bits.passes(F.lit(5)))
    assert value(spark, bits.position(F.lit("category"), F.lit("B"))) == 3 and value(spark, bits.position(F.lit("x"), F.lit("B"))) == -1
    assert value(spark, bits.mask(F.lit("type"), F.lit("external"))) == 64 and value(spark, bits.mask(F.lit("x"), F.lit("y"))) == 0
    assert value(spark, bits.ranges_overlap(F.lit(1), F.lit(3), F.lit(3), F.lit(5))) and not value(spark, bits.ranges_overlap(F.lit(1), F.lit(2), F.lit(3), F.lit(5)))


def test_text(spark):
    assert value(spark, text.clean(F.lit(" Hello,  world! 我 x "))) == "Hello world x"
    assert value(spark, text.tokens(F.lit("  B a b A c "))) == ["b", "a", "c"]
    assert value(spark, text.characters(F.lit("abca"))) == ["a", "b", "c"]
    assert value(spark, text.chunks(F.lit("aa bbb c dddddd ee"), 5)) == ["aa bbb", "c", "dddddd", "ee"]
    assert value(spark, text.chunks(F.lit("  "), 5)) == [] and value(spark, text.chunks(F.lit(None).cast("string"), 5)) is None
    assert value(spark, text.token_estimate(F.lit("abcde"))) == 2
    assert value(spark, text.html_text(F.lit("<p>a&amp;b<script>x</script> c"))) == "a&b c"
    assert value(spark, text.variable_byte_digits(F.lit(130))) == "0000000110000010"


def test_lsh(spark):
    vec = F.array(F.lit(1.0), F.lit(-2.0))
    assert value(spark, lsh.hyperplane_hash(vec, [[1, 0], [0, 1], [0, 0]])) == 1
    assert value(spark, lsh.hyperplane_hash(vec, [[1, 0], [0, 1], [0, 0]], inclusive=True)) == 5
    assert value(spark, lsh.projection_hash(vec, [1, 1], 0.5, 0.4)) == abs(math.floor(-0.5 / 0.4))
    assert value(spark, lsh.angular_hash(vec, [0, 0])) == 1
    features = F.array(F.lit(3).cast("long"), F.lit(9).cast("long"))
    assert value(spark, lsh.minhash(features, [2, 5], [1, 7])) == [7, 22]
    assert value(spark, lsh.minhash(F.array().cast("array<bigint>"), [2], [1])) == [None]
    assert value(spark, lsh.jaccard_estimate(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(3)))) == 0.5
    assert value(spark, lsh.jaccard_estimate(F.array(F.lit(1)), F.array(F.lit(1), F.lit(3)))) == 0
    base = 0b1010
    one = value(spark, lsh.probes(F.lit(base), 1, 4))
    assert sorted(one) == sorted([base, *(base ^ 1 << i for i in range(4))])
    assert set(one) < set(value(spark, lsh.probes(F.lit(base), 2, 4))) < set(value(spark, lsh.probes(F.lit(base), 3, 4)))
    assert value(spark, lsh.combined([F.lit(1), F.lit(1)])) == 3
    normals = lsh.planes(3, 4, 5)
    assert normals.shape == (3, 4, 5) and not np.allclose(normals[0], normals[1])
