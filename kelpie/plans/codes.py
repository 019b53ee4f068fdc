"""The code surfaces that several queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.functions.quantizers import REGISTRY
from kelpie.operators.scales import with_amax_scale
from kelpie.sources import vectors


def coded_cells(spark: SparkSession, sf_dir: str, name: str, granularity: str = "block-layer", multiplier: float = 1.0) -> DataFrame:
    """(layer, token, block, label, scale, head, channel, view, v, code, restored) of a registered quantizer.

    Scales are added to rows, before these are exploded to cells.
    """
    quantizer, divisor = REGISTRY[name]
    if granularity == "block-view":
        vecs = with_amax_scale(vectors.kv_vectors(spark, sf_dir), granularity, divisor, multiplier, "vec")
        cells = vecs.select("layer", "token", "block", "label", "scale", "head", "view", F.posexplode("vec").alias("channel", "v")).withColumn("channel", F.col("channel").cast("long"))
    else:
        cells = vectors.explode_cells(with_amax_scale(vectors.rows(spark, sf_dir), granularity, divisor, multiplier))
    code, restored = quantizer(F.col("v"), F.col("scale"))
    return cells.withColumn("code", code).withColumn("restored", restored)


def coded_rows(spark: SparkSession, sf_dir: str, name: str, granularity: str = "block-layer") -> DataFrame:
    """(layer, token, codes): the codes of coded_cells() in the row's own array; scales of a block of rows or of a row."""
    quantizer, divisor = REGISTRY[name]
    rows = with_amax_scale(vectors.rows(spark, sf_dir), granularity, divisor)
    return rows.select("layer", "token", F.transform("row", lambda v: quantizer(v, F.col("scale"))[0].cast("int")).alias("codes"))
