"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: No more than this is broadcast.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (tests) gets one of its own; a cluster must set it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "kelpie-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is still there when the driver ends is deleted then."""
    path = f"{shared_dir(spark)}/kelpie-{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it back with its own schema."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kelpie_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def discard(*frames: DataFrame) -> None:
    """Deletes the files of frames from materialize() that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_kelpie_path", None):
            delete(df.sparkSession, path)


def broadcast_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, marked for broadcast if its rows of row_bytes each are at most BROADCAST_BYTES; beyond, joins with it are left to the shuffle. df is counted, so it should be materialized."""
    return F.broadcast(df) if df.limit(BROADCAST_BYTES // row_bytes + 1).count() * row_bytes <= BROADCAST_BYTES else df


def text_hash(text: Column) -> Column:
    """Tells rows with the same doc_id but other texts apart; null and empty texts are the same."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def matching(docs: DataFrame, keys: DataFrame, how: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose (doc_id, text_hash()) is (left_semi) or is not (left_anti) among the materialized keys (doc_id, copy)."""
    keys = broadcast_small(keys.select(F.col("doc_id").alias("_kelpie_id"), F.col("copy").alias("_kelpie_copy")), 64)
    return docs.join(keys, docs[id_col].cast("long").eqNullSafe(keys["_kelpie_id"]) & (text_hash(docs[text_col]) == keys["_kelpie_copy"]), how)


def without(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return matching(docs, removed, "left_anti", id_col, text_col)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the decimal doc_id, modulo folds; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))
