"""Scalar functions are exact over the whole range of bigints."""

import math

import pytest
from pyspark.sql import functions as F

from graphloom.functions import numeric
from graphloom.operators.ordering import least_by

EDGE = [0, 1, -1, 2, 3, -3, 7, 2**49 - 1, 2**53 + 1, -(2**53) - 1, 2**62 + 5, 2**63 - 1, -(2**63)]


def test_division_is_exact(spark):
    pairs = [(a, b) for a in EDGE for b in EDGE]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    a, b = F.col("a"), F.col("b")
    rows = df.select("a", "b", numeric.ceil_div(a, b).alias("up"), numeric.floor_div(a, b).alias("down"), numeric.multiplies(a, b).alias("fits")).collect()
    for r in rows:
        if r.b == 0 or (r.a, r.b) == (-(2**63), -1):
            assert r.up is None and r.down is None
        else:
            assert (r.up, r.down) == (-(-r.a // r.b), r.a // r.b), (r.a, r.b)
        assert r.fits == (-(2**63) <= r.a * r.b < 2**63)


def test_rounding_and_multiples(spark):
    values = [5, -5, 6, 7, 2**53 + 1, 2**49 - 1]
    df = spark.createDataFrame([(v,) for v in values], "a bigint")
    a = F.col("a")
    for v, r in zip(values, df.select(numeric.round_div(a, F.lit(2)).alias("h"), numeric.round_div(a, F.lit(-2)).alias("g"), numeric.upper_multiple(a, 32).alias("up"), numeric.lower_multiple(a, 32).alias("down")).collect(), strict=True):
        assert (r.h, r.g) == ((2 * v + 2) // 4, (-2 * v + 2) // 4)
        assert (r.up, r.down) == (-(-v // 32) * 32, v // 32 * 32)


def test_logarithms_are_exact(spark):
    values = [1, 2, 3, 2**49 - 1, 2**49, 2**53 + 1, 2**62, 2**63 - 1]
    df = spark.createDataFrame([(v,) for v in values], "a bigint")
    got = df.select(numeric.floor_log2(F.col("a")).alias("f"), numeric.ceil_log2(F.col("a")).alias("c")).collect()
    assert [(r.f, r.c) for r in got] == [(v.bit_length() - 1, (v - 1).bit_length()) for v in values]


def test_other_scalars(spark):
    one = spark.createDataFrame([(10, 3, 0.5)], "a bigint, k bigint, r double")
    a, k, r = F.col("a"), F.col("k"), F.col("r")
    got = one.select(
        numeric.write_bit(a, F.lit(0)).alias("w1"), numeric.write_bit(a, F.lit(1), False).alias("w0"), numeric.per_cent(k, a).alias("p"), numeric.geometric_series(r, k).alias("g"), numeric.geometric_series(F.lit(1.0), k).alias("g1"),
        numeric.near(r, F.lit(0.5000001)).alias("near"), numeric.near(r, F.lit(0.6), 0.1, True).alias("far"), numeric.factorial(k).alias("f"), numeric.factorial(F.lit(21)).alias("f21"), numeric.bucket_hash(a, 7, 3).alias("h"), numeric.read_bit(a, F.lit(1)).alias("bit"),
    ).first()
    assert (got.w1, got.w0, got.p, got.g, got.g1, got.near, got.far, got.f, got.f21, got.bit) == (11, 8, 30.0, 1.75, 3.0, True, False, math.factorial(3), None, True)
    assert 0 <= got.h < 7


@pytest.mark.parametrize("one_task", [1, 1000])
def test_ordered_limit(spark, one_task):
    df = spark.range(300).select((F.col("id") * 7 % 300).alias("x"))
    assert sorted(r.x for r in least_by(df, [F.col("x")], 120, one_task=one_task).collect()) == list(range(120))
    assert least_by(df, [F.col("x")], 1000, one_task=one_task).count() == 300
    assert least_by(df.limit(0), [F.col("x")], 5, one_task=one_task).count() == 0
