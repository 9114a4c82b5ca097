"""Geometry and codecs on made-up vectors, against NumPy and by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vektora.functions import codecs
from vektora.functions.vectors import from_angles, norm, ranges, scaled, tails, to_angles


def one(spark, v, f):
    return spark.createDataFrame([(v,)], "v array<double>").select(f(F.col("v")).alias("x")).first().x


@pytest.mark.parametrize(
    "v, want",
    [
        ([0.0, 1.0], [math.pi / 2]),
        ([1.0, 0.0], [0.0]),
        ([0.0, -1.0], [3 * math.pi / 2]),
        ([0.0, 0.0, 1.0], [math.pi / 2, math.pi / 2]),
        ([0.0, 0.0, -1.0], [math.pi / 2, 3 * math.pi / 2]),
        ([1.0, 0.0, 0.0, 0.0], [0.0, math.pi / 2, 0.0]),
    ],
)
def test_angles_by_hand(spark, v, want):
    assert one(spark, v, lambda x: to_angles(x, len(v))) == pytest.approx(want)


def test_round_trip_and_tails(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(40, 16))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "i int, v array<double>")
    got = df.select("i", from_angles(to_angles(F.col("v"), 16)).alias("r"), tails(F.col("v")).alias("t")).orderBy("i").collect()
    assert np.abs(np.array([r.r for r in got]) - m).max() < 1e-7
    assert np.abs(np.array([r.t for r in got]) - np.sqrt(np.cumsum((m**2)[:, ::-1], axis=1)[:, ::-1])).max() < 1e-12


def test_bin_edges(spark):
    a = [0.0, math.pi / 4, math.pi / 2, math.pi - 1e-9, 7.0]
    assert one(spark, a, lambda x: F.transform(x, lambda t: codecs.angle_code(t, math.pi, 2))) == [0, 1, 2, 3, 3]
    assert one(spark, [0.1, 0.2], lambda x: codecs.angle_widths(x, ranges(3), [0, 0])) == pytest.approx([math.pi / 2, math.pi])


def test_cartesian_by_hand(spark):
    assert one(spark, [0.0, -0.5, 1.0], lambda x: codecs.shifted_codes(x, 8)) == [64, 0, 191]
    tiny = [0.05] * 16
    assert one(spark, tiny, lambda x: codecs.shifted_codes(x, 2)) == [1] * 16
    assert one(spark, tiny, lambda x: codecs.cartesian(x, 2)) == [0.0] * 16  # a zero vector, not NaN
    assert one(spark, [2.5, 3.5], lambda x: F.transform(x, F.rint)) == [2.0, 4.0]


def test_half_precision(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.uniform(-7, 7, 3000), 10.0 ** rng.uniform(-9, 4, 3000), [0.0, 65504.0, 2.0**-24, 6e-8]])
    got = np.array(one(spark, x.tolist(), lambda v: F.transform(v, codecs.half)))
    assert (got == x.astype(np.float16).astype(float)).all()


def test_zero_fill_and_mean_fill(spark):
    v = [0.5, 0.5, 0.5, 0.5]
    zero = one(spark, v, lambda x: from_angles(codecs.angle_clip(to_angles(x, 4), ranges(4), 8, [True, False, False], F.array(*[F.lit(0.0)] * 3))))
    assert zero[0] == pytest.approx(0.5, abs=0.01) and zero[1] == pytest.approx(math.sqrt(1 - zero[0] ** 2)) and zero[2:] == [0.0, 0.0]


def test_norms_of_decoded(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(20, 8))
    df = spark.createDataFrame([((r / np.linalg.norm(r)).tolist(),) for r in m], "v array<double>").withColumn("a", to_angles(F.col("v"), 8))
    made = [codecs.cartesian(F.col("v"), 8), codecs.symmetric_int8(F.col("v")), codecs.truncated(F.col("v"), 8, 5), from_angles(codecs.angle_uniform(F.col("a"), ranges(8), 4)), codecs.with_residual(F.col("v"), codecs.cartesian(F.col("v"), 4))]
    for row in df.select(*(norm(c).alias(f"n{i}") for i, c in enumerate(made))).collect():
        assert list(row) == pytest.approx([1.0] * len(made), abs=1e-6)


def test_nulls_and_zeros(spark):
    df = spark.createDataFrame([(None,), ([0.0, 0.0],)], "v array<double>")
    assert [r.x for r in df.select(scaled(F.col("v")).alias("x")).collect()] == [None, [0.0, 0.0]]
    assert [r.x for r in df.select(to_angles(F.col("v"), 2).alias("x")).collect()] == [None, [0.0]]
