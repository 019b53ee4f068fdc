"""Pooled rate and distortion metrics: numerators and denominators are summed first, then divided; ratios are never averaged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.functions.numeric import entropy

FLOOR = 1e-30


def distortion(cells: DataFrame, keys: list[str], value: str = "v", restored: str = "restored") -> DataFrame:
    """(keys, n_values, error_square, reference_square)."""
    e = F.col(restored) - F.col(value)
    return cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_values"), F.sum(e * e).alias("error_square"), F.sum(F.col(value) * F.col(value)).alias("reference_square"))


def pooled_ratio(df: DataFrame, keys: list[str], numerator: str, denominator: str, name: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.sum(numerator) / F.greatest(F.sum(denominator), F.lit(FLOOR))).alias(name))


def histogram(cells: DataFrame, keys: list[str], levels: int, code: str = "code") -> DataFrame:
    """(keys, code, n) with zeros for absent codes; the code range, a few hundred rows at most, is the bounded side."""
    spark = cells.sparkSession
    counts = cells.groupBy(*keys, code).agg(F.count(F.lit(1)).alias("n"))
    every = counts.select(*keys).distinct().crossJoin(F.broadcast(spark.range(levels).select(F.col("id").cast("int").alias(code)))) if keys else spark.range(levels).select(F.col("id").cast("int").alias(code))
    return every.join(counts, [*keys, code], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def code_entropy(cells: DataFrame, keys: list[str], code: str = "code") -> DataFrame:
    """(keys, entropy_bits, unique_symbols, n_values) from the histogram, which is small whatever the number of cells."""
    counts = cells.groupBy(*keys, code).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    joined = counts.join(F.broadcast(totals), keys) if keys else counts.crossJoin(F.broadcast(totals))
    return joined.groupBy(*keys).agg(entropy("n", "total").alias("entropy_bits"), F.count(F.lit(1)).alias("unique_symbols"), F.sum("n").alias("n_values"))


def conditional_entropy(pairs: DataFrame, left: str = "before", right: str = "code") -> DataFrame:
    """H(right given left) in bits of a frame of pairs."""
    joint = pairs.groupBy(left, right).agg(F.count(F.lit(1)).alias("n"))
    rows = joint.groupBy(left).agg(F.sum("n").alias("row_n"))
    total = joint.agg(F.sum("n").alias("total"))
    out = joint.join(rows, left).crossJoin(F.broadcast(total))
    return out.agg(F.coalesce(F.sum(-F.col("n") / F.col("total") * F.log2(F.col("n") / F.col("row_n"))), F.lit(0.0)).alias("conditional_entropy_bits"), F.coalesce(F.max("total"), F.lit(0)).alias("pair_count"))


def residual_statistics(pairs: DataFrame, left: str = "before", right: str = "code") -> DataFrame:
    """Entropy of the signed residual, mean absolute residual, share of zeros, number of pairs and of distinct residuals."""
    counts = pairs.select((F.col(right) - F.col(left)).alias("r")).groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    out = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total"))))
    return out.agg(
        entropy("n", "total").alias("residual_entropy_bits"),
        (F.sum(F.abs("r") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))).alias("absolute_residual_mean"),
        (F.sum(F.when(F.col("r") == 0, F.col("n")).otherwise(0)) / F.greatest(F.sum("n"), F.lit(1))).alias("zero_residual_fraction"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("pair_count"),
        F.count(F.lit(1)).alias("unique_residuals"),
    )


def rate_summary(df: DataFrame, bitstream: str = "bitstream_bytes", metadata: str = "metadata_bytes", values: str = "n_values") -> DataFrame:
    """Adds total_bytes, bits_per_value and ratio_vs_bf16."""
    total = F.col(bitstream) + F.col(metadata)
    return df.withColumn("total_bytes", total).withColumn("bits_per_value", total * F.lit(8.0) / F.greatest(F.col(values), F.lit(1))).withColumn("ratio_vs_bf16", F.col(values) * F.lit(2.0) / F.greatest(total, F.lit(1)))


def against_baseline(df: DataFrame, arm: str, baseline: str, columns: list[str]) -> DataFrame:
    """Adds <column>_vs_baseline = (base - value) / base for the one row of the baseline arm."""
    base = df.filter(F.col(arm) == baseline).select(*[F.col(c).alias(f"_base_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(base))
    for c in columns:
        out = out.withColumn(f"{c}_vs_baseline", (F.col(f"_base_{c}") - F.col(c)) / F.col(f"_base_{c}")).drop(f"_base_{c}")
    return out
