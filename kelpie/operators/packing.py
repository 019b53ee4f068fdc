"""Packing of codes, frame layouts and a DEFLATE size as a portable stand-in for a video codec."""

from __future__ import annotations

import shutil
import subprocess
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEUTRAL_BYTE = 128
TOKENS_PER_FRAME = 8


def packed_bytes(codes: DataFrame, keys: list[str], order: str, bits: int, code: str = "code") -> DataFrame:
    """(keys, byte, packed): little lanes of `bits` bits in the order given by the dense position `order` (from 0); the last byte is filled with zeros."""
    lanes = 8 // bits
    place = F.col(order)
    value = F.col(code).cast("int").bitwiseAND(F.lit((1 << bits) - 1))
    shifted = (value * F.pow(F.lit(2), (place % lanes) * bits)).cast("long")
    return codes.select(*keys, F.floor(place / lanes).cast("long").alias("byte"), shifted.alias("_v")).groupBy(*keys, "byte").agg(F.sum("_v").alias("packed"))


def unpacked_codes(packed: DataFrame, keys: list[str], bits: int) -> DataFrame:
    lanes = 8 // bits
    out = packed.select(*keys, "byte", "packed", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("_k"))
    return out.select(*keys, (F.col("byte") * lanes + F.col("_k")).alias("place"), F.floor(F.col("packed") / F.pow(F.lit(2), F.col("_k") * bits)).cast("long").bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("code"))


#: By model the views that a token is padded to, and whether the second half of the views stands beside the first.
GEOMETRIES = {"qwen": (64, True), "glm": (16, False), "deepseek": (32, False)}


def frame_shape(model: str, views: int, width: int, tokens_per_frame: int = TOKENS_PER_FRAME) -> tuple[int, int, int]:
    """Rows of a token that views fill, and height and width of a frame."""
    if model not in GEOMETRIES or tokens_per_frame < 1:
        raise ValueError("unknown geometry")
    padded, folded = GEOMETRIES[model]
    filled = views // 2 if folded else views
    if folded and views % 2 or filled > padded:
        raise ValueError("the views do not fit the geometry")
    return filled, tokens_per_frame * padded, width * (2 if folded else 1)


def token_frames(rows: DataFrame, model: str, views: int, width: int, keys: list[str] | None = None, tokens_per_frame: int = TOKENS_PER_FRAME) -> DataFrame:
    """(keys, frame, height, width, pixels, held): frames of some tokens with padded views, as one array by rows, from rows (keys, token, view, codes array).

    Absent cells hold the neutral byte; `held` has the places (token of the frame * views + view) of the rows that are there. One shuffle brings a frame's rows together; no cell is exploded.
    """
    keys = keys or []
    padded, folded = GEOMETRIES[model]
    filled, height, full = frame_shape(model, views, width, tokens_per_frame)
    line = (F.col("token") % tokens_per_frame * padded + F.col("view") % filled).cast("int")
    entry = F.struct(line.alias("line"), F.col("codes").cast("array<int>").alias("codes"))
    side = F.floor(F.col("view") / filled)
    place = (F.col("token") % tokens_per_frame * views + F.col("view")).cast("int")
    placed = rows.select(*keys, F.floor(F.col("token") / tokens_per_frame).cast("long").alias("frame"), place.alias("place"), F.when(side == 0, entry).alias("first"), F.when(side == 1, entry).alias("second"))
    halves = ["first", "second"] if folded else ["first"]
    held = placed.groupBy(*keys, "frame").agg(*[F.map_from_entries(F.collect_list(h)).alias(h) for h in halves], F.collect_list("place").alias("held"))
    none = F.array_repeat(F.lit(NEUTRAL_BYTE), width)
    pixels = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda r: F.concat(*[F.coalesce(F.element_at(F.col(h), r), none) for h in halves])))
    return held.select(*keys, "frame", F.lit(height).alias("height"), F.lit(full).alias("width"), pixels.alias("pixels"), "held")


def frame_rows(frames: DataFrame, model: str, views: int, width: int, tokens: str | None = None, keys: list[str] | None = None, tokens_per_frame: int = TOKENS_PER_FRAME) -> DataFrame:
    """(keys, token, view, codes): the inverse of token_frames(), without padded views and absent rows.

    The rows are those in `held`; with the name of a column `tokens`, frames need no `held` and have all rows of the tokens below it.
    """
    keys = keys or []
    padded, folded = GEOMETRIES[model]
    filled, _, full = frame_shape(model, views, width, tokens_per_frame)
    every = F.sequence(F.lit(0), F.lit(tokens_per_frame * views - 1)) if tokens else F.col("held")
    out = frames.select(*keys, "frame", *([tokens] if tokens else []), "pixels", F.explode(every).alias("_i"))
    view = F.col("_i") % views
    at = (F.floor(F.col("_i") / views) * padded + view % filled) * full + F.floor(view / filled) * width
    token = F.col("frame") * tokens_per_frame + F.floor(F.col("_i") / views)
    out = out.filter(token < F.col(tokens)) if tokens else out
    return out.select(*keys, token.cast("long").alias("token"), view.cast("long").alias("view"), F.slice("pixels", (at + 1).cast("int"), width).alias("codes"))


def pack_array(codes, bits: int) -> bytes:
    """Little lanes of `bits` bits; the last byte is filled with zeros."""
    lanes = 8 // bits
    x = np.asarray(codes, dtype=np.int64) & (1 << bits) - 1
    x = np.append(x, np.zeros(-len(x) % lanes, dtype=np.int64)).reshape(-1, lanes)
    return (x << np.arange(lanes) * bits).sum(axis=1).astype(np.uint8).tobytes()


def unpack_array(packed: bytes, bits: int, count: int) -> np.ndarray:
    lanes = 8 // bits
    if len(packed) != -(-count // lanes):
        raise ValueError("the packed codes have another length")
    x = np.frombuffer(packed, dtype=np.uint8)[:, None] >> np.arange(lanes, dtype=np.uint8) * bits & (1 << bits) - 1
    return x.reshape(-1)[:count]


def e4m3_codes(x: np.ndarray) -> np.ndarray:
    """The E4M3 bytes of an array (ties to even, clamped to +-448, zero without a sign)."""
    a = np.minimum(np.abs(x), 448.0)
    e = np.maximum(np.frexp(np.maximum(a, 2.0**-60))[1] - 1, -6)
    units = np.rint(a / np.exp2(e - 3.0)).astype(np.int64)  # 8..16 for normals; 16 is the next exponent's first
    code = np.where(units >= 8, (e + 7) * 8 + units - 8, units)
    return np.where((x < 0) & (units > 0), code + 128, code).astype(np.uint8)


def fp8_planes(rows: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """(keys, place, packed): the bits of each row's E4M3 bytes transposed, 8 planes of D / 8 bytes, low bits first (D a multiple of 8); in Arrow batches, without a shuffle."""
    schema = ", ".join(f"{k} {t}" for k, t in rows.select(*keys).dtypes) + ", planes array<int>"

    def run(batches):
        for batch in batches:
            column = batch.column(len(keys))
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 8))
            planes = np.packbits(np.unpackbits(e4m3_codes(x)[:, :, None], axis=2, bitorder="little").swapaxes(1, 2).reshape(len(x), -1), axis=1, bitorder="little").astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * planes.shape[1]), pa.array(planes.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], lists], [*keys, "planes"])

    planes = rows.select(*keys, F.col(vec).cast("array<double>").alias("vec")).mapInArrow(run, schema)
    return planes.select(*keys, F.posexplode("planes").alias("place", "packed"))


def deflate_sizes(streams: DataFrame, keys: list[str], order: list[str], codes: str, bits: int, level: int = 6) -> DataFrame:
    """(keys, raw_bytes, zip_bytes): each stream's codes (arrays of ints) packed and compressed in order.

    Rows are sorted inside the shuffle and fed to one compressor for each key as they come, so that a task holds a batch at a time.
    """
    spark = streams.sparkSession
    schema = ", ".join(f"{k} {t}" for k, t in streams.select(*keys).dtypes) + ", raw_bytes long, zip_bytes long"

    def run(batches):
        now, state, raw, size = None, None, 0, 0
        names = [*keys, "raw_bytes", "zip_bytes"]
        done = []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(keys) + 1)]
            for *key, own in zip(*columns, strict=True):
                if key != now:
                    if now is not None:
                        done.append([*now, raw, size + len(state.flush())])
                    now, state, raw, size = key, zlib.compressobj(level=level), 0, 0
                data = pack_array(own, bits)
                raw += len(data)
                size += len(state.compress(data))
        if now is not None:
            done.append([*now, raw, size + len(state.flush())])
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = streams.repartition(parts, *keys).sortWithinPartitions(*keys, *order)
    return ordered.select(*keys, codes).mapInArrow(run, schema)


def video_codec_available() -> bool:
    """Whether an external ffmpeg is there; without it encoded sizes are not reported, and never replaced by stand-ins."""
    return shutil.which("ffmpeg") is not None


def video_sizes(frames: DataFrame, keys: list[str], params: str, ffmpeg: str = "ffmpeg") -> DataFrame:
    """(keys, raw_bytes, stream_bytes, exact) of groups of gray frames (frame, height, width, pixels binary), each encoded losslessly by one external process and decoded again.

    A group is one closed group of pictures, so that groups need nothing of each other and a task holds one of them. Fails where the encoder does.
    """
    schema = ", ".join(f"{k} {t}" for k, t in frames.select(*keys).dtypes) + ", raw_bytes long, stream_bytes long, exact boolean"

    def call(arguments: list[str], data: bytes) -> bytes:
        done = subprocess.run([ffmpeg, "-hide_banner", "-loglevel", "error", "-threads", "1", *arguments], input=data, capture_output=True, timeout=600)
        if done.returncode:
            raise RuntimeError(done.stderr.decode(errors="replace")[-2000:])
        return done.stdout

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("frame")
        height, width = (table.column(n)[0].as_py() for n in ("height", "width"))
        raw = b"".join(table.column("pixels").to_pylist())
        stream = call(["-f", "rawvideo", "-pix_fmt", "gray", "-s", f"{width}x{height}", "-r", "1", "-i", "pipe:0", "-an", "-c:v", "libx265", "-x265-params", params, "-f", "hevc", "pipe:1"], raw)
        back = call(["-f", "hevc", "-i", "pipe:0", "-pix_fmt", "gray", "-f", "rawvideo", "pipe:1"], stream)
        return pa.table({**{k: table.column(k).slice(0, 1) for k in keys}, "raw_bytes": pa.array([len(raw)], pa.int64()), "stream_bytes": pa.array([len(stream)], pa.int64()), "exact": [back == raw]})

    return frames.groupBy(*keys).applyInArrow(run, schema)


def lossless_rates(frames: DataFrame, arm: str, about: DataFrame, inter: str, intra: str, ffmpeg: str = "ffmpeg") -> DataFrame:
    """(arm, raw_bytes, intra_bytes, bitstream_bytes, metadata_bytes, n_values, total_bytes, bits_per_value, ratio_vs_bf16, inter_gain) of frames (arm, gop, frame, height, width, pixels).

    Every group of pictures is a task of its own, encoded with and without prediction between frames and decoded again; the query fails if one came back changed. `about` has (arm, metadata_bytes, n_values), a row for each arm.
    """
    from kelpie.operators.metrics import rate_summary

    def sizes(params: str, name: str) -> DataFrame:
        found = video_sizes(frames, [arm, "gop"], params, ffmpeg)
        checked = found.filter(F.when(F.col("exact"), True).otherwise(F.raise_error(F.concat(F.lit("a group came back changed: "), F.col("gop").cast("string")))))
        return checked.groupBy(arm).agg(F.sum("raw_bytes").alias(f"_raw_{name}"), F.sum("stream_bytes").alias(name))

    both = sizes(inter, "bitstream_bytes").join(sizes(intra, "intra_bytes"), arm).withColumnRenamed("_raw_bitstream_bytes", "raw_bytes").drop("_raw_intra_bytes")
    return rate_summary(both.join(about, arm)).withColumn("inter_gain", 1 - F.col("bitstream_bytes") / F.col("intra_bytes"))


# The encoder's default cell, its limit, and the parameters of token frames in their order.
X265_DEFAULTS = {"lossless": "1", "keyint": "32", "min-keyint": "32", "scenecut": "0", "bframes": "3", "b-adapt": "2", "rc-lookahead": "4", "log-level": "error"}
X265_MOST_BFRAMES = 16
TOKEN_PARAMETERS = "lossless=1 scenecut=0 bframes=3 b-adapt=2 open-gop=0 log-level=error keyint={frames} min-keyint={frames} pools=1 frame-threads=1 wpp=1 pmode=0 rskip=0 early-skip=0 fast-intra=0 signhide=0 sao=0 strong-intra-smoothing=0 weightp=0 weightb=0 aq-mode=0 cutree=0 rd=3 subme=3 psy-rd=0 psy-rdoq=0 ctu={ctu} range=full annexb=1 repeat-headers=1 hash=1 rc-lookahead=4"


def token_parameters(frames: int, height: int) -> str:
    """The parameters of lossless token frames: one closed group of pictures, and coding units no larger than the frame asks for."""
    return ":".join(TOKEN_PARAMETERS.format(frames=frames, ctu=16 if height < 32 else 32 if height < 64 else 64).split())


def b_adapt(bframes: int, wanted: int | None = None) -> int:
    """Without B-frames 0; with them what is wanted, or where that is nothing or 0: 1 for a single B-frame, else 2."""
    if wanted not in (None, 0, 1, 2):
        raise ValueError("b-adapt is 0, 1 or 2")
    if bframes <= 0:
        return 0
    return wanted or (1 if bframes == 1 else 2)


def x265_params(**changes: str | int) -> str:
    """key=value pairs joined by colons; later values win and keep the first one's place. The lookahead must exceed the number of B-frames."""
    merged = X265_DEFAULTS | {k.replace("_", "-"): str(v) for k, v in changes.items()}
    bframes = int(merged["bframes"])
    if not 0 <= bframes <= X265_MOST_BFRAMES:
        raise ValueError(f"bframes is 0 to {X265_MOST_BFRAMES}")
    merged["b-adapt"] = str(b_adapt(bframes, int(changes["b_adapt"]) if "b_adapt" in changes else None))
    if bframes and int(merged["rc-lookahead"]) <= bframes:
        merged["rc-lookahead"] = str(bframes + 1)
    return ":".join(f"{k}={v}" for k, v in merged.items())


# The encoder's input format for a surface of so many bits, and its sample range.
PIXEL_FORMATS = {8: "gray", 10: "gray10le", 12: "gray12le"}


def pixel_format(levels: int) -> str:
    """The gray format with the fewest bits that holds `levels` codes."""
    for bits, name in PIXEL_FORMATS.items():
        if 0 < levels <= 1 << bits:
            return name
    raise ValueError("no gray format holds so many levels")


def sample_range(pixels: DataFrame, column: str = "code") -> DataFrame:
    """(lowest, highest, full_range): whether samples leave the limited range of 16 to 235, which an encoder may clip to."""
    ends = pixels.agg(F.min(column).alias("lowest"), F.max(column).alias("highest"))
    return ends.withColumn("full_range", (F.col("lowest") < 16) | (F.col("highest") > 235))


def mismatches(left: DataFrame, right: DataFrame, keys: list[str], code: str = "code", examples: int = 5) -> DataFrame:
    """(cells, different, missing, first): how a decoded surface departs from its source, with the first places at which it does."""
    a, b = left.select(*keys, F.col(code).alias("_a")), right.select(*keys, F.col(code).alias("_b"))
    both = a.join(b, keys, "full_outer").withColumn("_off", ~F.col("_a").eqNullSafe(F.col("_b")))
    first = both.filter("_off").select(F.struct(*keys, F.col("_a").alias("source"), F.col("_b").alias("decoded")).alias("at")).orderBy("at").limit(examples).agg(F.sort_array(F.collect_list("at")).alias("first"))
    count = both.agg(F.count(F.lit(1)).alias("cells"), F.sum(F.col("_off").cast("long")).alias("different"), F.sum((F.col("_a").isNull() | F.col("_b").isNull()).cast("long")).alias("missing"))
    return count.crossJoin(F.broadcast(first))
