import random

import pytest
from pyspark.sql import functions as F

from signfold.functions import codec, losses


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def arr(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_pack_of_the_hand_made_case(spark):
    x = arr(1, -1, 0, 2, -3, 4, 5, -6)
    assert one(spark, codec.pack(x, 8)) == (0b10010110,)
    assert one(spark, codec.binarize(x)) == ([True, False, False, True, False, True, True, False],)


def test_pack_and_unpack_are_inverse(spark):
    r = random.Random(1)
    rows = [(i, [r.choice([-1.5, 0.0, 2.0]) for _ in range(64)]) for i in range(30)] + [(30, [1.0] * 64), (31, [-1.0] * 64)]
    df = spark.createDataFrame(rows, "id int, x array<float>").withColumn("fp", codec.pack("x"))
    for row in df.select("x", "fp", codec.unpack("fp").alias("b"), codec.popcount("fp").alias("n"), codec.pack_words("x", 64).alias("w")).collect():
        assert row.b == [v > 0 for v in row.x] and row.n == sum(row.b) and row.w == [row.fp]


def test_distances_agree(spark):
    r = random.Random(2)
    rows = [([r.uniform(-1, 1) for _ in range(100)], [r.uniform(-1, 1) for _ in range(100)]) for _ in range(20)]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    got = df.select("a", "b", codec.hamming_words(codec.pack_words("a", 100), codec.pack_words("b", 100)).alias("w"), codec.hamming_bools(codec.binarize("a"), codec.binarize("b")).alias("d")).collect()
    assert all(g.w == g.d == sum((x > 0) != (y > 0) for x, y in zip(g.a, g.b)) for g in got)
    assert one(spark, codec.hamming(F.lit(0b1011), F.lit(0b0110))) == (3,)


def test_bytes_and_digits(spark):
    assert one(spark, codec.key_to_bytes(F.lit(258).cast("bigint"))) == ([0, 0, 0, 0, 0, 0, 1, 2],)
    assert one(spark, codec.key_to_digits(F.lit(407).cast("bigint"), 10, 3)) == ([4, 0, 7],)
    assert one(spark, codec.key_to_mosaic(F.lit(1234).cast("bigint"), 10, 2, 2)) == ([[1, 2], [3, 4]],)
    for v in (0, 1, 255, 2**40 + 17, 2**63 - 1, -1, -(2**63)):
        x = F.lit(v).cast("bigint")
        assert one(spark, codec.bytes_to_key(codec.key_to_bytes(x)), codec.key_to_binary(x)) == (v, bytearray((v % 2**64).to_bytes(8, "big")))
    big = 10**15 + 7
    x = F.lit(big).cast("bigint")
    assert one(spark, codec.digits_to_key(codec.key_to_digits(x, 1000, 6), 1000), codec.mosaic_to_key(codec.key_to_mosaic(x, 100, 2, 4), 100)) == (big, big)
    with pytest.raises(OverflowError):
        codec.check_capacity(256, 8)
    assert codec.check_capacity(2, 63) == 2**63


def test_fnv1(spark):
    def want(v):
        h = 0xCBF29CE484222325
        for b in (v % 2**64).to_bytes(8, "big"):
            h = (h * 0x100000001B3) % 2**64 ^ b
        return h

    for v in (0, 1, 77, 2**40 + 3, -5):
        hi, lo = codec.fnv1(F.lit(v).cast("bigint"))
        assert one(spark, hi, lo, codec.slot(F.lit(v).cast("bigint"), 40)) == (want(v) >> 32, want(v) & 0xFFFFFFFF, want(v) & (2**40 - 1))


def test_small_helpers(spark):
    assert one(spark, codec.format_id(F.lit(1234567))) == ("001-234-567",)
    assert one(spark, codec.has_repeats(F.array(F.lit(1), F.lit(2), F.lit(1))), codec.has_repeats(F.array(F.lit(1), F.lit(2)))) == (True, False)
    assert one(spark, codec.saturated(arr(-2, 0.5, 3, 1), 1.0)) == (0.5,)


def test_losses(spark):
    import math

    got = one(spark, losses.huber(F.lit(2.0), 2, 4), losses.huber(F.lit(6.0), 2, 4), losses.huber_slope(F.lit(-6.0), 2, 4), losses.polynomial_schedule(F.lit(399), 1, 0.005, 0.5, 200), losses.heaviside(F.lit(0.0)), losses.straight_sign(F.lit(-3.0)))
    assert got == pytest.approx((1.0, 8.0, -2.0, math.sqrt(2), 1, -1))
    big = one(spark, losses.log_sigmoid(F.lit(-800.0)), losses.softplus(F.lit(800.0)), losses.log_sum_exp(arr(-1000, -1000)), losses.log_add_exp(F.lit(3.0), F.lit(3.0)))
    assert big == pytest.approx((-800, 800, -1000 + math.log(2), 3 + math.log(2)))
    s = lambda v: 1 / (1 + math.exp(-v))
    a, b = [0.3, -2.0], [1.0, 0.5]
    differ, agree = losses.bernoulli_equality(arr(*a), arr(*b))
    d, g = one(spark, differ, agree)
    assert [math.exp(x) + math.exp(y) for x, y in zip(d, g)] == pytest.approx([1, 1])
    assert g == pytest.approx([math.log(s(x) * s(y) + s(-x) * s(-y)) for x, y in zip(a, b)])
    # The slope is that of the loss, by central differences.
    e = 1e-5
    up, down, slope = one(spark, losses.hamming_loss(arr(0.3 + e, -2), arr(*b)), losses.hamming_loss(arr(0.3 - e, -2), arr(*b)), losses.hamming_loss_slope(arr(*a), arr(*b)))
    assert slope[0] == pytest.approx((up - down) / (2 * e), rel=1e-4)
    assert one(spark, losses.kl_to_bernoulli(arr(0.0, 0.0), 0.5))[0] == pytest.approx(0, abs=1e-12)
    assert one(spark, losses.pair_loss(losses.tanh_dot(arr(1), arr(1)), F.lit(1), 2.0))[0] == pytest.approx(math.log1p(math.exp(-2 * math.tanh(1) ** 2)))
    assert losses.inverse_permutation([2, 0, 1]) == [1, 2, 0]
    assert one(spark, losses.permuted(losses.permuted(arr(5, 6, 7), [2, 0, 1]), losses.inverse_permutation([2, 0, 1]))) == ([5.0, 6.0, 7.0],)
