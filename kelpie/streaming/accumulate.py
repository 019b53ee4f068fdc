"""Mergeable accumulators over a stream of vector files.

Every micro-batch writes its partial sums under its own number, so that a batch
that runs again after a failure replaces its part and counts once; the result is
the sum over parts. The checkpoint remembers which files are done, so that a run
goes on where the last one ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.functions.quantizers import REGISTRY
from kelpie.operators.scales import with_amax_scale

SCHEMA = "vec_id long, embedding array<float>, label int"


def code_parts(rows: DataFrame, quantizer: str = "int8") -> DataFrame:
    """(layer, code, n) of rows (vec_id, embedding) under a scale for each row."""
    code, divisor = REGISTRY[quantizer]
    wide = with_amax_scale(rows.select((F.col("vec_id") % 4).alias("layer"), F.col("embedding").cast("array<double>").alias("row")), "token-layer", divisor)
    cells = wide.select("layer", F.explode(F.transform("row", lambda v: code(v, F.col("scale"))[0])).alias("code"))
    return cells.groupBy("layer", "code").agg(F.count(F.lit(1)).alias("n"))


def accumulate(spark: SparkSession, source: str, parts: str, checkpoint: str, quantizer: str = "int8", pattern: str = "*.parquet") -> None:
    """Takes in all files of `source` that are not yet counted, and stops."""
    stream = spark.readStream.schema(SCHEMA).option("pathGlobFilter", pattern).parquet(source)

    def put(batch: DataFrame, number: int) -> None:
        code_parts(batch, quantizer).write.mode("overwrite").parquet(f"{parts}/batch={number}")

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def merged(spark: SparkSession, parts: str) -> DataFrame:
    """(layer, code, n) over all batches."""
    rows = spark.read.schema("layer long, code int, n long, batch int").parquet(parts)
    return rows.groupBy("layer", "code").agg(F.sum("n").alias("n"))
