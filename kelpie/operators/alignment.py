"""Alignment of layers and heads: total joins, unit rows, cosines, cyclic controls, slabs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpie.functions.numeric import dot, unit


def synchronized(df: DataFrame, keys: list[str], layer: str, layers: int) -> DataFrame:
    """(keys, n_layers, total): each key must be there once in each layer. The full outer equi-join of all layers, as one aggregation."""
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(layer).alias("n_layers"))
    return found.withColumn("total", (F.col("n_layers") == layers) & (F.col("n_rows") == layers))


def require_synchronized(df: DataFrame, keys: list[str], layer: str, layers: int) -> DataFrame:
    """As synchronized(), but fails on a missing or repeated position."""
    checked = synchronized(df, keys, layer, layers)
    return checked.filter(F.when(F.col("total"), True).otherwise(F.raise_error(F.lit("layers are not aligned"))))


def whole_segments(df: DataFrame, segment: Column, size: int, valid: Column) -> DataFrame:
    """The rows of segments whose `size` tokens are all there and valid; one invalid token drops its segment."""
    marked = df.withColumn("segment", segment).withColumn("_valid", valid)
    good = marked.groupBy("layer", "segment").agg(F.min(F.col("_valid").cast("int")).alias("_all"), F.count(F.lit(1)).alias("_n"))
    kept = good.groupBy("segment").agg(F.min(((F.col("_all") == 1) & (F.col("_n") == size)).cast("int")).alias("_ok")).filter("_ok = 1").select("segment")
    return marked.join(kept, "segment", "left_semi").drop("_valid")


#: Slabs that are numbered in one task.
SLABS_EACH = 4096


def evenly_spaced(df: DataFrame, order: str, count: int) -> DataFrame:
    """`count` rows of a frame of distinct slabs, evenly spaced with both ends (half to even); all for count <= 0 or >= their number, the middle one for 1.

    `order` is a number. Slabs are numbered within runs of SLABS_EACH numbers, on top of the sums of the runs before: the one window without a partition has a line for each run.
    """
    if count <= 0:
        return df
    marked = df.withColumn("_run", F.floor(F.col(order) / SLABS_EACH))
    runs = marked.groupBy("_run").agg(F.count(F.lit(1)).alias("_held"))
    base = F.sum("_held").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("_run", F.coalesce(base, F.lit(0)).alias("_base"))
    ranked = marked.withColumn("_at", F.row_number().over(Window.partitionBy("_run").orderBy(order)) - 1).join(runs, "_run").withColumn("_i", F.col("_base") + F.col("_at"))
    ranked = ranked.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_n")))).select(*df.columns, "_i", "_n")
    if count == 1:
        return ranked.filter("_i = _n div 2").drop("_i", "_n")
    spaced = F.expr(f"exists(sequence(0, {count - 1}), k -> cast(rint(k * (_n - 1) / {count - 1}) as bigint) = _i)")
    return ranked.filter((F.col("_n") <= count) | spaced).drop("_i", "_n")


def rolled(token: Column, shift: Column, length: Column) -> Column:
    """The token that stands at this place after a cyclic shift within a chunk; a shift of 0 modulo the length counts as 1."""
    s = F.pmod(shift, length)
    return F.pmod(token - F.when(s == 0, F.lit(1)).otherwise(s), length)


def pair_cosines(left: DataFrame, right: DataFrame, on: Column, keys: list[str], vec: str = "vec") -> DataFrame:
    """(keys, cosine_sum, pair_count) of pairs of vectors of two aliased frames l and r."""
    joined = left.alias("l").join(right.alias("r"), on)
    cosine = dot(unit(F.col(f"l.{vec}")), unit(F.col(f"r.{vec}")))
    return joined.select(*[F.col(k) if "." not in k else F.col(k).alias(k.replace(".", "_")) for k in keys], cosine.alias("c")).groupBy(*[k.replace(".", "_") for k in keys]).agg(F.sum("c").alias("cosine_sum"), F.count(F.lit(1)).alias("pair_count"))


def templates(df: DataFrame, vec: str = "vec", dim: int = 16) -> DataFrame:
    """(layer, token, vec): the unit row of the mean over heads, channel by channel in one aggregation."""
    means = df.groupBy("layer", "token").agg(*[F.avg(F.col(vec)[i]).alias(f"m{i}") for i in range(dim)])
    return means.select("layer", "token", unit(F.array(*[F.col(f"m{i}") for i in range(dim)])).alias("vec"))
