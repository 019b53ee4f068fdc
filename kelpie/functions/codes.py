"""Bijections between byte and nibble codes, as integer columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A fixed bijection of bytes, code -> (FACTOR * code + OFFSET) mod 256; our own, as a seeded table of another library cannot be reproduced.
FACTOR, OFFSET = 167, 13


def fp8_mono_encode(code: Column) -> Column:
    """Numeric order of sign-magnitude bytes as unsigned order."""
    return F.when(code >= 128, 255 - code).otherwise(code + 128)


def fp8_mono_decode(code: Column) -> Column:
    return F.when(code >= 128, code - 128).otherwise(255 - code)


def e4m3_sign_mantissa(code: Column) -> Column:
    return F.shiftright(code, 7) * 8 + code.bitwiseAND(F.lit(7))


def e4m3_exponent(code: Column) -> Column:
    return F.shiftright(code, 3).bitwiseAND(F.lit(15))


def e4m3_join(sign_mantissa: Column, exponent: Column) -> Column:
    return F.shiftright(sign_mantissa, 3) * 128 + exponent.bitwiseAND(F.lit(15)) * 8 + sign_mantissa.bitwiseAND(F.lit(7))


def high(code: Column) -> Column:
    return F.shiftright(code, 4)


def low(code: Column) -> Column:
    return code.bitwiseAND(F.lit(15))


def nibbles_join(high_nibble: Column, low_nibble: Column) -> Column:
    return F.shiftleft(high_nibble, 4).bitwiseOR(low_nibble)


def high4_mono_encode(nibble: Column) -> Column:
    return F.when(nibble >= 8, 15 - nibble).otherwise(nibble + 8)


def high4_mono_decode(nibble: Column) -> Column:
    return F.when(nibble >= 8, nibble - 8).otherwise(15 - nibble)


def sm_to_gray(sign_mantissa: Column) -> Column:
    """Rank of sign and mantissa, kept in the high nibble."""
    m = sign_mantissa.bitwiseAND(F.lit(7))
    return F.when(sign_mantissa >= 8, 7 - m).otherwise(8 + m) * 16


def gray_to_sm(gray: Column) -> Column:
    rank = F.shiftright(gray, 4)
    return F.when(rank < 8, 8 + 7 - rank).otherwise(rank - 8)


def permute(code: Column) -> Column:
    return (code * FACTOR + OFFSET) % 256


def unpermute(code: Column) -> Column:
    return F.pmod((code - OFFSET) * pow(FACTOR, -1, 256), F.lit(256))


def nibble_bytes(count: Column) -> Column:
    return F.floor((count + 1) / 2).cast("long")
