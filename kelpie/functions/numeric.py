"""Numeric column builders. All compute in DOUBLE and round half to even; none needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exponent(x: Column) -> Column:
    """floor(log2(x)) of x > 0, exact also next to powers of two, where log2 alone is off by one."""
    f = F.floor(F.log2(x)).cast("double")
    two = F.lit(2.0)
    return F.when(F.pow(two, f) > x, f - 1).when(F.pow(two, f + 1) <= x, f + 1).otherwise(f)


def _to_ulp(x: Column, rounded, bits: int) -> Column:
    ulp = F.pow(F.lit(2.0), exponent(x) - bits)
    return F.when(x > 0, rounded(x / ulp) * ulp).otherwise(F.lit(0.0))


def bf16(x: Column) -> Column:
    """The nearest BF16 value of x >= 0."""
    return _to_ulp(x, F.rint, 7)


def bf16_up(x: Column) -> Column:
    """The smallest BF16 value at or above x >= 0."""
    return _to_ulp(x, lambda y: F.ceil(y).cast("double"), 7)


def fp16(x: Column) -> Column:
    """The nearest half-precision value (ties to even); beyond its range infinite, subnormals in steps of 2^-24."""
    a = F.abs(x)
    e = F.greatest(exponent(F.greatest(a, F.lit(2.0**-30))), F.lit(-14.0))
    step = F.pow(F.lit(2.0), e - 10)
    rounded = F.rint(a / step) * step
    return F.signum(x) * F.when(rounded > 65504.0, F.lit(float("inf"))).otherwise(rounded)


def amax_scale(amax: Column, divisor: float, multiplier: float = 1.0) -> Column:
    """BF16 of amax * multiplier / divisor; 1 where amax is 0."""
    return F.when(amax > 0, bf16(amax * F.lit(multiplier) / F.lit(divisor))).otherwise(F.lit(1.0))


def power_of_two_scale(amax: Column, divisor: float) -> Column:
    """The smallest power of two at or above amax / divisor, within 2^-127..2^127; 1 where amax is 0."""
    raw = F.greatest(amax / F.lit(divisor), F.lit(2.0**-127))
    e = exponent(raw)
    up = F.when(F.pow(F.lit(2.0), e) == raw, e).otherwise(e + 1)
    return F.when(amax > 0, F.pow(F.lit(2.0), F.least(F.greatest(up, F.lit(-127.0)), F.lit(127.0)))).otherwise(F.lit(1.0))


def count_below(x: Column, bounds: list[float]) -> Column:
    """How many bounds lie strictly below x; a value on a bound stays in the lower bin."""
    out = F.lit(0)
    for b in bounds:
        out = out + (x > F.lit(b)).cast("int")
    return out


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def e4m3(x: Column) -> Column:
    """The nearest E4M3 value (ties to even) after clamping to +-448; subnormals in steps of 2^-9."""
    a = F.least(F.abs(x), F.lit(448.0))
    e = F.greatest(F.when(a > 0, exponent(F.greatest(a, F.lit(2.0**-60)))).otherwise(F.lit(-6.0)), F.lit(-6.0))
    step = F.pow(F.lit(2.0), e - 3)
    return F.signum(x) * F.rint(a / step) * step


def e4m3_byte(x: Column) -> Column:
    """The byte of a value that e4m3() has rounded: sign, 4 bits of exponent, 3 of mantissa. Zero is 0, whatever its sign."""
    a = F.abs(x)
    e = F.greatest(F.when(a > 0, exponent(F.greatest(a, F.lit(2.0**-60)))).otherwise(F.lit(-6.0)), F.lit(-6.0))
    units = (a / F.pow(F.lit(2.0), e - 3)).cast("int")  # 8..15 for normals, 0..7 for subnormals
    low = F.when(units >= 8, (e + 7).cast("int") * 8 + units - 8).otherwise(units)
    return F.when(x < 0, low + 128).otherwise(low)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column, eps: float = 1e-8) -> Column:
    """a divided by its L2 norm, or by eps if that is larger."""
    n = F.greatest(norm(a), F.lit(eps))
    return F.transform(a, lambda x: x / n)


def amax(a: Column) -> Column:
    return F.array_max(F.transform(a, F.abs))


def bits(x: Column, scale: float = 1.0) -> Column:
    """log2(1 + |x| / scale): the cost of a residual."""
    return F.log2(F.lit(1.0) + F.abs(x) / F.lit(scale))


def entropy(count: str, total: str) -> Column:
    """Shannon entropy in bits as an aggregate over rows of counts with their total; 0 without any."""
    p = F.col(count) / F.col(total)
    return F.coalesce(-F.sum(F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0))), F.lit(0.0))
