"""Manifests, packets and reports: explicit schemas, eager checks, atomic sinks."""

from __future__ import annotations

import json
import platform
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The format tags and fields of the files that are read.
SHARD_FORMAT = "qwen35-qk-sequence-shards-v1"
SHARDS = "format string, shards array<struct<sequence_index: int, worker_files: array<string>, key_token_sha256: string, prompt_token_sha256: string>>"
RECORDS = "status string, groups array<struct<kind: string, layers: array<int>, views: int, dim: int>>, records array<struct<split: string, domain: string, task: string, tokens: long, slots: long, groups: array<struct<path: string, sha256: string, kind: string>>>>"
PACKET_FORMATS = ["kvcodec-token-hevc-v1", "kvcodec-token-hevc-v2", "ours-hi4-token-hevc-v1"]
HEADER = "format string, model string, frames int, height int, width int, views int, `groups` array<int>, tokens int, tokens_per_frame int, values long, low4_bytes int, low4_order string, held string, view_numbers array<int>, range_floor_views int"


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(sequence_index, file, key_token_sha256, prompt_token_sha256); fails on another format or on a shard with more than one file."""
    raw = spark.read.schema(SHARDS).option("mode", "FAILFAST").option("multiLine", True).json(path)
    checked = raw.filter(F.coalesce(F.assert_true(F.col("format") == SHARD_FORMAT, F.lit("unknown shard format")), F.lit(True)))
    one = checked.select(F.explode("shards").alias("s"))
    file = F.when(F.size("s.worker_files") == 1, F.element_at("s.worker_files", 1)).otherwise(F.raise_error(F.lit("a shard has one file")))
    return one.select("s.sequence_index", file.alias("file"), "s.key_token_sha256", "s.prompt_token_sha256")


def read_records(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """One row for each group of each record of a completed manifest; split filters records before groups are exploded."""
    raw = spark.read.schema(RECORDS).option("mode", "FAILFAST").option("multiLine", True).json(path)
    raw = raw.filter(F.coalesce(F.assert_true(F.col("status") == "complete", F.lit("manifest is not complete")), F.lit(True)))
    records = raw.select(F.explode("records").alias("r"))
    if split is not None:
        records = records.filter(F.col("r.split") == split)
    return records.select("r.split", "r.domain", "r.task", "r.tokens", "r.slots", F.explode("r.groups").alias("g")).select("split", "domain", "task", "tokens", "slots", "g.path", "g.sha256", "g.kind")


def file_hashes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def cache_kind(name: Column) -> Column:
    """key, k, keys and value, v, values by one name; null for others."""
    n = F.lower(F.trim(name))
    return F.when(n.isin("key", "k", "keys"), "key").when(n.isin("value", "v", "values"), "value")


def pack_header(header: Column) -> Column:
    """A little-endian length and the JSON text."""
    text = header.cast("binary")
    size = F.octet_length(text)
    return F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(size, 8 * k).bitwiseAND(F.lit(255))), 2, "0")) for k in range(4)], text)


def packet_size(packet: Column) -> Column:
    """The header's length from the first four bytes."""
    byte = [F.conv(F.hex(F.substring(packet, k + 1, 1)), 16, 10).cast("long") for k in range(4)]
    return byte[0] + byte[1] * 256 + byte[2] * 65536 + byte[3] * 16777216


def parse_packet(packets: DataFrame, column: str = "packet") -> DataFrame:
    """Adds `header` (struct), `scales`, `low` (the low nibbles of the split format, else empty) and `payload` (binary); fails on an unknown format or a truncated packet."""
    n = packet_size(F.col(column))
    out = packets.withColumn("_n", n).withColumn("header", F.from_json(F.expr(f"substring({column}, 5, cast(_n as int))").cast("string"), HEADER))
    out = out.withColumn("_low", F.coalesce("header.low4_bytes", F.lit(0)))
    good = F.col("header.format").isin(PACKET_FORMATS) & (F.octet_length(column) >= 4 + F.col("_n") + 2 * F.col("header.views") + F.col("_low"))
    out = out.withColumn("header", F.when(good, F.col("header")).otherwise(F.raise_error(F.lit("wrong or truncated packet"))))
    out = out.withColumn("scales", F.expr(f"substring({column}, cast(5 + _n as int), header.views * 2)")).withColumn("low", F.expr(f"substring({column}, cast(5 + _n + header.views * 2 as int), _low)"))
    return out.withColumn("payload", F.expr(f"substring({column}, cast(5 + _n + header.views * 2 + _low as int))")).drop("_n", "_low")


def _paths(spark: SparkSession):
    """The file system of a path, and the path, as Hadoop objects."""
    hadoop = spark._jvm.org.apache.hadoop.fs

    def of(path: str):
        found = hadoop.Path(path)
        return found.getFileSystem(spark._jsc.hadoopConfiguration()), found

    return of


def resolve_file(spark: SparkSession, name: str, folder: str) -> str:
    """A file by its absolute path, by its path under the manifest's folder or, where neither is there, by its name anywhere under the folder, if that is unique."""
    of = _paths(spark)
    for path in ([name] if "://" in name or name.startswith("/") else []) + [f"{folder}/{name}"]:
        system, found = of(path)
        if system.exists(found):
            return str(system.resolvePath(found))
    last, hits = name.rsplit("/", 1)[-1], []
    system, top = of(folder)
    files = system.listFiles(top, True) if system.exists(top) else None
    while files is not None and files.hasNext():
        found = files.next().getPath()
        if found.getName() == last:
            hits.append(str(found))
    if len(hits) != 1:
        raise FileNotFoundError(f"{len(hits)} files named {last} under {folder}")
    return hits[0]


def require_agreement(sources: DataFrame, columns: list[str], layer: str = "layer", source: str = "source") -> DataFrame:
    """(layer, source): fails if a layer comes from more than one source, or if sources differ in one of the columns (heads, dimension, length, fingerprints)."""
    differ = sources.agg(*[(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("null"))) > 1).alias(c) for c in columns])
    bad = F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in columns]))
    checked = differ.select(F.when(F.size(bad) == 0, True).otherwise(F.raise_error(F.concat(F.lit("sources differ in "), F.array_join(bad, ", ")))).alias("_ok"))
    layers = sources.groupBy(layer).agg(F.count_distinct(source).alias("_n"), F.min(source).alias(source))
    one = layers.filter(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit("a layer has several sources")))).drop("_n")
    return one.crossJoin(F.broadcast(checked)).filter("_ok").drop("_ok")


def available_sequences(shards: DataFrame) -> list[int]:
    """The sequence numbers of a manifest, ascending: a line for each shard."""
    return [r["sequence_index"] for r in shards.select("sequence_index").distinct().orderBy("sequence_index").collect()]


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """df, which must have a row."""
    if not df.limit(1).count():
        raise ValueError(f"no {what}")
    return df


def check_records(records: DataFrame, heads: int, splits: tuple[str, str] = ("a", "b")) -> DataFrame:
    """The rows of read_records(), whose splits must have no file and no task in common, and whose files must have one hash each."""
    pairs = records.select("split", F.explode(F.array(F.concat(F.lit("file "), "path"), F.concat(F.lit("task "), "task"))).alias("what")).distinct()
    shared = pairs.filter(F.col("split").isin(*splits)).groupBy("what").agg(F.count_distinct("split").alias("n")).filter("n > 1")
    hashes = records.groupBy("path").agg(F.count_distinct("sha256").alias("n")).filter("n <> 1 or path is null")
    for found, said in ((shared, "splits share"), (hashes, "a file without one hash:")):
        if row := found.first():
            raise ValueError(f"{said} {row[0]}")
    if heads < 1:
        raise ValueError("at least one head")
    return records


def verify_hashes(records: DataFrame) -> DataFrame:
    """(path, sha256): the files of records, read and hashed; fails on one that differs."""
    files = records.select("path", "sha256").distinct()
    found = file_hashes(records.sparkSession, [r["path"] for r in files.select("path").distinct().collect()])  # a line for each file
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    both = files.join(found.select(plain(F.col("path")).alias("_p"), F.col("sha256").alias("_found")), plain(F.col("path")) == F.col("_p"), "left")
    return both.filter(F.when(F.col("sha256").eqNullSafe(F.col("_found")), True).otherwise(F.raise_error(F.concat(F.lit("hash mismatch: "), "path")))).select("path", "sha256")


def load_matrices(spark: SparkSession, path: str, dim: int, most_bytes: int = 64 << 20) -> DataFrame:
    """(layer, head, matrix array<array<double>>) of final rotations, marked for broadcast up to most_bytes; fails on another dimension or a repeated view."""
    raw = spark.read.parquet(path).select(F.col("layer").cast("long").alias("layer"), F.col("head").cast("long").alias("head"), F.col("matrix").cast("array<array<double>>").alias("matrix"))
    square = (F.size("matrix") == dim) & F.forall("matrix", lambda row: F.size(row) == dim)
    raw = raw.filter(F.when(square, True).otherwise(F.raise_error(F.lit("a rotation has another dimension"))))
    return _bounded(raw, dim * dim * 8, most_bytes)


def load_means(spark: SparkSession, path: str, dim: int, most_bytes: int = 64 << 20) -> DataFrame:
    """(layer, head, mean array<double>), as load_matrices()."""
    raw = spark.read.parquet(path).select(F.col("layer").cast("long").alias("layer"), F.col("head").cast("long").alias("head"), F.col("mean").cast("array<double>").alias("mean"))
    return _bounded(raw.filter(F.when(F.size("mean") == dim, True).otherwise(F.raise_error(F.lit("a mean has another dimension")))), dim * 8, most_bytes)


def _bounded(table: DataFrame, row_bytes: int, most_bytes: int) -> DataFrame:
    if table.groupBy("layer", "head").count().filter("count > 1").limit(1).count():
        raise ValueError("a view stands in the table twice")
    return F.broadcast(table) if table.count() * row_bytes <= most_bytes else table


def export_blocks(rows: DataFrame, path: str, first: int, blocks: int = 4, size: int = 256, token: str = "token") -> DataFrame:
    """Writes `blocks` consecutive blocks of `size` tokens from token `first` on, a folder for each, with a manifest of rows and versions beside them; fails if one is not whole."""
    block = F.floor((F.col(token) - first) / size).cast("long")
    kept = rows.filter((F.col(token) >= first) & (F.col(token) < first + blocks * size)).withColumn("test_block", block)
    held = {r["test_block"]: r["n"] for r in kept.groupBy("test_block").agg(F.count_distinct(token).alias("n")).collect()}  # a line for each block
    if held != {b: size for b in range(blocks)}:
        raise ValueError("a block is not whole")
    kept.write.mode("errorifexists").partitionBy("test_block").parquet(f"{path}/blocks")
    spark = rows.sparkSession
    about = spark.range(1).select(F.lit(first).alias("first_token"), F.lit(blocks).alias("blocks"), F.lit(size).alias("block_tokens"), F.lit(spark.version).alias("spark_version"), F.lit(platform.python_version()).alias("python_version"), F.lit(json.dumps(rows.dtypes)).alias("columns"))
    write_report(about, f"{path}/manifest")
    return spark.read.parquet(f"{path}/blocks")


def write_report(df: DataFrame, path: str, kind: str = "json") -> None:
    """A report beside the old one, which gives way only when the new one is whole: a reader sees one of the two, or for the moment between two renames none, but never a part."""
    of, fresh = _paths(df.sparkSession), f"{path}.{uuid.uuid4().hex}"
    getattr(df.write, kind)(f"{fresh}.new")
    (system, old), (_, new), (_, away) = of(path), of(f"{fresh}.new"), of(f"{fresh}.old")
    had = system.exists(old)
    if had and not system.rename(old, away) or not system.rename(new, old):
        raise OSError(f"could not put a report at {path}")
    if had:
        system.delete(away, True)
