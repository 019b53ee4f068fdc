"""Streams that are read to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.plans.base import int_sql, query
from kelpie.streaming import accumulate


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the driver ends; a local session without one gets its own."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        top = f"file://{tempfile.gettempdir()}/kelpie-shared"
    path = f"{top.rstrip('/')}/kelpie-{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


@query("stream_code_histogram", f"WITH {int_sql('token-layer', 8)} SELECT layer, code::INTEGER AS code, count(*) AS n FROM coded GROUP BY 1, 2")
def stream_code_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code counts of a stream of vector files, taken in by micro-batches that may run again."""
    folder = _scratch(spark, "stream")
    jpath = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/embeddings.parquet")
    inside = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).isDirectory()
    source, pattern = (f"{sf_dir}/embeddings.parquet", "*.parquet") if inside else (sf_dir, "embeddings.parquet")
    accumulate.accumulate(spark, source, f"{folder}/parts", f"{folder}/checkpoint", pattern=pattern)
    return accumulate.merged(spark, f"{folder}/parts").select("layer", F.col("code").cast("int").alias("code"), "n")
