"""Boundaries, ties, zero and saturation of the numeric columns and quantizers."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpie.functions import codes as C
from kelpie.functions import numeric as N
from kelpie.functions import quantizers as Q


def column(spark, values, build):
    frame = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, x double")
    return [r[1] for r in frame.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


def bf16(x, up=False):
    e = math.frexp(x)[1] - 1
    ulp = math.ldexp(1.0, e - 7)
    q = x / ulp
    return (math.ceil(q) if up else round(q)) * ulp


def probes():
    out = []
    for e in range(-30, 31):
        p = 2.0**e
        out += [p, np.nextafter(p, 0), np.nextafter(p, 1e300), p * 1.5, p * 1.00390625, p * 1.01171875]
    return out


def test_exponent_next_to_powers(spark):
    xs = probes()
    assert column(spark, xs, N.exponent) == [float(math.frexp(x)[1] - 1) for x in xs]


def test_bf16(spark):
    xs = probes()
    assert column(spark, xs, N.bf16) == [bf16(x) for x in xs]
    assert column(spark, xs, N.bf16_up) == [bf16(x, True) for x in xs]
    single = [struct.unpack("<f", struct.pack("<I", struct.unpack("<I", struct.pack("<f", x))[0] & 0xFFFF0000))[0] for x in xs]
    assert all(abs(a - b) <= abs(b) / 64 for a, b in zip(column(spark, xs, N.bf16), single, strict=True))


def test_scale_of_nothing(spark):
    assert column(spark, [0.0, 6.0], lambda x: N.amax_scale(x, 6.0)) == [1.0, 1.0]
    assert column(spark, [0.0, 6.0, 7.0], lambda x: N.power_of_two_scale(x, 6.0)) == [1.0, 1.0, 2.0]


def e4m3_table():
    """All non-negative values by the format's definition."""
    return [(m / 8) * 2.0**-6 if e == 0 else (1 + m / 8) * 2.0 ** (e - 7) for e in range(16) for m in range(8)][:127]


def test_e4m3(spark):
    table = e4m3_table()
    xs = [t for t in table] + [(a + b) / 2 for a, b in zip(table, table[1:], strict=False)] + [448.0, 449.0, 1e9, 0.0]
    got = column(spark, xs, N.e4m3)
    for x, y in zip(xs, got, strict=True):
        near = sorted(table, key=lambda t: (abs(t - min(x, 448.0)), table.index(t) % 2))[0]
        assert y == near
    assert column(spark, [-x for x in xs], N.e4m3) == [-y for y in got]
    assert column(spark, table, lambda x: N.e4m3_byte(x)) == list(range(127))
    assert column(spark, [-1.0, -448.0], lambda x: N.e4m3_byte(x)) == [0xB8, 0xFE]


def test_fp4_bounds(spark):
    bounds = Q.E2M1_BOUNDS
    xs = bounds + [np.nextafter(b, 9) for b in bounds] + [-b for b in bounds] + [0.0, -0.0, 7.0, -7.0]
    got = column(spark, xs, lambda x: Q.fp4(x, F.lit(1.0))[0])
    assert got[:7] == [8 + i for i in range(7)] and got[7:14] == [9 + i for i in range(7)]
    assert got[14:21] == [7 - i for i in range(7)]
    assert got[21:] == [8, 8, 15, 0]


@pytest.mark.parametrize("bits", [2, 3, 4, 8])
def test_integer_ties_and_clamps(spark, bits):
    top = (1 << bits - 1) - 1
    xs = [0.5, 1.5, -0.5, -1.5, 1000.0, -1000.0]
    got = column(spark, xs, lambda x: Q.intn(bits)(x, F.lit(1.0))[0])
    assert got == [max(-top, min(top, round(x))) + top + 1 for x in xs]


def test_int2_is_two_sided(spark):
    assert column(spark, [-9.0, -1.5, -0.5, 0.5, 9.0], lambda x: Q.int2(x, F.lit(1.0))[0]) == [0, 0, 2, 2, 3]


def test_lloyd_max_bounds(spark):
    assert column(spark, Q.LM4_BOUNDS, lambda x: Q.lloyd_max(Q.LM4_LEVELS, Q.LM4_BOUNDS)(x, F.lit(1.0))[0]) == list(range(15))


def test_unclipped_overflow_fails(spark):
    with pytest.raises(Exception, match="range overflow"):
        column(spark, [200.0], lambda x: Q.int8_unclipped(x, F.lit(1.0))[0])


def test_bijections(spark):
    frame = spark.range(256).select(F.col("id").cast("int").alias("c"))
    c = F.col("c")
    row = frame.agg(
        *[F.countDistinct(f(c)) for f in (C.fp8_mono_encode, C.permute)],
        F.min((C.fp8_mono_decode(C.fp8_mono_encode(c)) == c).cast("int")),
        F.min((C.unpermute(C.permute(c)) == c).cast("int")),
        F.min((C.e4m3_join(C.e4m3_sign_mantissa(c), C.e4m3_exponent(c)) == c).cast("int")),
        F.min((C.nibbles_join(C.high(c), C.low(c)) == c).cast("int")),
        F.min((C.high4_mono_decode(C.high4_mono_encode(C.low(c))) == C.low(c)).cast("int")),
        F.min((C.gray_to_sm(C.sm_to_gray(C.low(c))) == C.low(c)).cast("int")),
    ).first()
    assert tuple(row) == (256, 256, 1, 1, 1, 1, 1, 1)
