"""Scales of quantizers. Frames hold one array for each (layer, token) in `row`, so that a scale of a token needs no shuffle
and the others shuffle one partial maximum for each row, not its cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.functions.numeric import amax, amax_scale, bf16, bf16_up, power_of_two_scale

#: The keys that share a scale.
GRANULARITY = {"token-layer": ["layer", "token"], "block-layer": ["layer", "block"], "block-view": ["layer", "block", "head"], "gop": ["block"]}


def amax_scales(df: DataFrame, granularity: str, divisor: float, multiplier: float = 1.0, array: str = "row") -> DataFrame:
    """(keys, amax, scale); block-view needs one row for each head."""
    keys = GRANULARITY[granularity]
    return df.groupBy(*keys).agg(F.max(amax(F.col(array))).alias("amax")).withColumn("scale", amax_scale(F.col("amax"), divisor, multiplier))


def with_amax_scale(df: DataFrame, granularity: str, divisor: float, multiplier: float = 1.0, array: str = "row") -> DataFrame:
    """Adds `scale`; of a token by projection alone, else by a join on the keys."""
    if granularity == "token-layer":
        return df.withColumn("scale", amax_scale(amax(F.col(array)), divisor, multiplier))
    return df.join(amax_scales(df, granularity, divisor, multiplier, array).drop("amax"), GRANULARITY[granularity])


def group_amax(array: Column, size: int) -> Column:
    """The amax of each run of `size` consecutive channels."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / size).cast("int")), lambda g: F.array_max(F.transform(F.slice(array, g * size + 1, F.lit(size)), F.abs)))


def channel_group_scales(df: DataFrame, size: int, divisor: float, array: str = "vec") -> DataFrame:
    """Adds `group`, `amax`, `scale_bf16` (2 bytes) and `scale_ue8m0` (a power of two, 1 byte), one row for each group of channels."""
    out = df.select(*[c for c in df.columns if c != array], F.posexplode(group_amax(F.col(array), size)).alias("group", "amax"))
    return out.withColumn("scale_bf16", amax_scale(F.col("amax"), divisor)).withColumn("scale_ue8m0", power_of_two_scale(F.col("amax"), divisor))


def square_sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x * x)


def rms_to_scale(rms: Column) -> Column:
    return F.when(rms > 0, bf16(rms)).otherwise(F.lit(1.0))


def rms_scales(df: DataFrame, keys: list[str], array: str = "row", multiplier: float = 1.0) -> DataFrame:
    """(keys, rms, scale) over the real values only; a short last block is not padded."""
    sums = df.groupBy(*keys).agg(F.sum(square_sum(F.col(array))).alias("_s"), F.sum(F.size(array)).alias("_n"))
    return sums.withColumn("rms", F.sqrt(F.col("_s") / F.col("_n")) * F.lit(multiplier)).withColumn("scale", rms_to_scale(F.col("rms"))).drop("_s", "_n")


def rms_scale_of_row(array: Column) -> Column:
    return rms_to_scale(F.sqrt(square_sum(array) / F.size(array)))


def view_scales_up(df: DataFrame, keys: list[str], epsilon: float, array: str = "vec") -> DataFrame:
    """(keys, error, floor, scale, floor_wins): the larger of sqrt(12) * epsilon * RMS and amax / 127, rounded up to BF16; 1 if zero."""
    sums = df.groupBy(*keys).agg(F.sum(square_sum(F.col(array))).alias("_s"), F.sum(F.size(array)).alias("_n"), F.max(amax(F.col(array))).alias("_a"))
    out = sums.select(*keys, (F.sqrt(F.lit(12.0)) * F.lit(epsilon) * F.sqrt(F.col("_s") / F.col("_n"))).alias("error"), (F.col("_a") / F.lit(127.0)).alias("floor"))
    target = F.greatest("error", "floor")
    return out.withColumn("scale", F.when(target > 0, bf16_up(target)).otherwise(F.lit(1.0))).withColumn("floor_wins", (F.col("floor") >= F.col("error")).cast("int"))


def scale_count(granularity: str, layers: int, tokens: int, heads: int, block: int) -> int:
    blocks = -(-tokens // block)
    return {"token-layer": layers * tokens, "block-layer": layers * blocks, "block-view": layers * blocks * heads, "gop": blocks}[granularity]
