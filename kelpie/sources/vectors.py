"""Vector tables as (layer, token, head) rows, derived from a table of embeddings.

layer = vec_id mod 4, token = vec_id div 4, head = position div 16, channel =
position mod 16; `label` is the domain. A row of the source is one (layer, token),
so that slicing it into heads or channels needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAYERS, HEADS, DIM, BLOCK = 4, 4, 16, 32


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(layer, token, block, label, row): one row for each layer and token, with all heads' channels in one array."""
    source = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    token = F.floor(F.col("vec_id") / LAYERS).cast("long")
    return source.select((F.col("vec_id") % LAYERS).alias("layer"), token.alias("token"), F.floor(token / BLOCK).cast("long").alias("block"), F.col("label"), F.col("embedding").cast("array<double>").alias("row"))


def head_slice(row: Column, head: Column) -> Column:
    return F.slice(row, (head * DIM + 1).cast("int"), DIM)


def kv_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(layer, token, block, label, head, view, vec)."""
    wide = rows(spark, sf_dir).select("*", F.explode(F.array(*[F.lit(h).cast("long") for h in range(HEADS)])).alias("head"))
    return wide.select("layer", "token", "block", "label", "head", (F.col("layer") * HEADS + F.col("head")).alias("view"), head_slice(F.col("row"), F.col("head")).alias("vec"))


def explode_cells(df: DataFrame, array: str = "row", name: str = "v") -> DataFrame:
    """One row for each channel of the (layer, token) rows: adds head, channel and view."""
    wide = df.select(*[c for c in df.columns if c != array], F.posexplode(array).alias("_p", name))
    head = F.floor(F.col("_p") / DIM).cast("long")
    return wide.select(*[c for c in wide.columns if c not in ("_p", name)], head.alias("head"), (F.col("_p") % DIM).cast("long").alias("channel"), (F.col("layer") * HEADS + head).alias("view"), name)


def kv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(layer, token, block, label, head, channel, view, v)."""
    return explode_cells(rows(spark, sf_dir))
