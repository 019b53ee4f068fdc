"""Packets of a cache's objects: INT8 codes of token frames, by views with their scales, through a lossless coder.

A packet is a little-endian length, a JSON header, the scales (the high halves of
float32), for the split format the packed low nibbles, and the coder's payload.
The coder is the external HEVC encoder where it is installed; DEFLATE stands in
for it elsewhere, and its sizes are never called video sizes. Objects are some
hundred tokens long, so that one task holds few of them at a time.

An object has the tokens that any of its views has. Where a view lacks some of them, the
header tells which rows are there (`held`, a bit for each view and token), and where views
are not numbered from 0 on, their numbers (`view_numbers`); other packets have neither.
"""

from __future__ import annotations

import base64
import json
import struct
import subprocess
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.operators.packing import GEOMETRIES, NEUTRAL_BYTE, TOKENS_PER_FRAME, frame_shape, pack_array, token_parameters, unpack_array

# The tags of the two formats, and of the first version of the whole one.
WHOLE, SPLIT, FORMATS = "kvcodec-token-hevc-v2", "ours-hi4-token-hevc-v1", ("kvcodec-token-hevc-v1", "kvcodec-token-hevc-v2", "ours-hi4-token-hevc-v1")
LOW_ORDER = "first_symbol_in_low_nibble"


class Deflate:
    """A portable lossless coder."""

    def encode(self, frames: np.ndarray) -> bytes:
        return zlib.compress(frames.tobytes(), 6)

    def decode(self, payload: bytes, frames: int, height: int, width: int) -> np.ndarray:
        return np.frombuffer(zlib.decompress(payload), dtype=np.uint8).reshape(frames, height, width)


class Video:
    """Lossless HEVC by an external process; the samples are the luma plane, the chroma planes are neutral."""

    def __init__(self, ffmpeg: str = "ffmpeg"):
        self.ffmpeg = ffmpeg

    def _call(self, arguments: list[str], data: bytes) -> bytes:
        quiet = ["-hide_banner", "-loglevel", "error", "-threads", "1", "-filter_threads", "1"]
        done = subprocess.run([self.ffmpeg, *quiet, *arguments, "-threads", "1", "pipe:1"], input=data, capture_output=True, timeout=300)
        if done.returncode or not done.stdout:
            raise RuntimeError(done.stderr.decode(errors="replace")[-2000:])
        return done.stdout

    def encode(self, frames: np.ndarray) -> bytes:
        n, height, width = frames.shape
        raw = np.concatenate((frames.reshape(n, -1), np.full((n, height * width // 2), NEUTRAL_BYTE, np.uint8)), axis=1).tobytes()
        source = ["-f", "rawvideo", "-pix_fmt", "yuv420p", "-video_size", f"{width}x{height}", "-framerate", "1", "-i", "pipe:0"]
        return self._call([*source, "-frames:v", str(n), "-an", "-c:v", "libx265", "-preset", "veryfast", "-x265-params", token_parameters(n, height), "-pix_fmt", "yuv420p", "-f", "hevc"], raw)

    def decode(self, payload: bytes, frames: int, height: int, width: int) -> np.ndarray:
        raw = self._call(["-f", "hevc", "-i", "pipe:0", "-frames:v", str(frames), "-vf", "extractplanes=y", "-pix_fmt", "gray", "-f", "rawvideo"], payload)
        return np.frombuffer(raw, dtype=np.uint8).reshape(frames, height, width)


def lay_out(codes: np.ndarray, model: str, tokens_per_frame: int = TOKENS_PER_FRAME) -> np.ndarray:
    """[views, tokens, width] as frames [frame, row, column]."""
    views, tokens, width = codes.shape
    filled, height, full = frame_shape(model, views, width, tokens_per_frame)
    beside = np.concatenate(np.split(codes, views // filled), axis=2)
    count = -(-tokens // tokens_per_frame)
    grid = np.full((count * tokens_per_frame, GEOMETRIES[model][0], full), NEUTRAL_BYTE, np.uint8)
    grid[:tokens, :filled] = beside.swapaxes(0, 1)
    return grid.reshape(count, height, full)


def take_back(frames: np.ndarray, model: str, views: int, tokens: int, tokens_per_frame: int = TOKENS_PER_FRAME) -> np.ndarray:
    """The inverse of lay_out()."""
    padded, folded = GEOMETRIES[model]
    filled = views // 2 if folded else views
    rows = frames.reshape(-1, padded, frames.shape[2])[:tokens, :filled].swapaxes(0, 1)
    return np.concatenate(np.split(rows, views // filled, axis=2), axis=0)


def quantize(x: np.ndarray, epsilon: float, held: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Codes, scales and the number of views whose range sets the scale: the larger of sqrt(12) * epsilon * RMS and amax / 127 of a view, up to BF16.

    With held [views, tokens] the other rows are zeros, which no RMS counts.
    """
    rows = x.shape[1] if held is None else held.sum(axis=1)
    error, least = np.sqrt(12.0) * epsilon * np.sqrt((x**2).sum(axis=(1, 2)) / (rows * x.shape[2])), np.abs(x).max(axis=(1, 2)) / 127
    target = np.maximum(error, least)
    ulp = np.exp2(np.frexp(np.where(target > 0, target, 1.0))[1] - 8.0)
    scales = np.where(target > 0, np.ceil(target / ulp) * ulp, 1.0)
    q = np.rint(x / scales[:, None, None])
    if np.abs(q).max(initial=0) > 127:
        raise ValueError("INT8 range overflow")
    return (q + 128).astype(np.uint8), scales, int((least >= error).sum())


def encode(x: np.ndarray, groups: list[int], model: str, epsilon: float, coder, split: bool = False, held: np.ndarray | None = None, numbers: list[int] | None = None) -> bytes:
    """The packet of one object [views, tokens, width]; groups are the sizes of its groups of views, held the rows that are there (else all), numbers the views' own (else from 0 on)."""
    codes, scales, floors = quantize(x, epsilon, held)
    frames = lay_out(codes >> 4 if split else codes, model)
    head = {"format": SPLIT if split else WHOLE, "model": model, "frames": frames.shape[0], "height": frames.shape[1], "width": frames.shape[2], "views": len(scales), "groups": groups, "tokens": x.shape[1], "tokens_per_frame": TOKENS_PER_FRAME}
    low = pack_array(codes.reshape(-1) & 15, 4) if split else b""
    if split:
        head |= {"values": codes.size, "low4_bytes": len(low), "low4_order": LOW_ORDER}
    if held is not None and not held.all():
        head["held"] = base64.b64encode(np.packbits(held).tobytes()).decode()
    if numbers is not None and numbers != list(range(len(scales))):
        head["view_numbers"] = numbers
    header = json.dumps(head | {"range_floor_views": floors}, separators=(",", ":")).encode()
    halves = (scales.astype(np.float32).view(np.uint32) >> 16).astype("<u2").tobytes()
    return struct.pack("<I", len(header)) + header + halves + low + coder.encode(frames)


def parse(packet: bytes) -> tuple[dict, np.ndarray, bytes, bytes]:
    """Header, scales, low nibbles (none in the whole format) and payload; fails on another format and on a truncated packet."""
    if len(packet) < 4 or len(packet) < 4 + (n := struct.unpack_from("<I", packet)[0]):
        raise ValueError("truncated packet")
    head, at = json.loads(packet[4 : 4 + n]), 4 + n
    if head.get("format") not in FORMATS:
        raise ValueError("wrong packet format")
    after = at + 2 * head["views"]
    end = after + head.get("low4_bytes", 0)
    if end > len(packet):
        raise ValueError("truncated packet")
    scales = (np.frombuffer(packet[at:after], dtype="<u2").astype(np.uint32) << 16).view(np.float32)
    return head, scales, packet[after:end], packet[end:]


def held_rows(head: dict, tokens: int) -> np.ndarray:
    """Which rows [views, tokens] a packet with this header holds."""
    count = head["views"] * tokens
    if "held" not in head:
        return np.ones((head["views"], tokens), bool)
    bits = np.frombuffer(base64.b64decode(head["held"], validate=True), dtype=np.uint8)
    if len(bits) != -(-count // 8):
        raise ValueError("the mask of rows has another length")
    return np.unpackbits(bits, count=count).reshape(-1, tokens).astype(bool)


def decode(packet: bytes, coder) -> tuple[np.ndarray, np.ndarray]:
    """The codes [views, tokens, width] and the scales."""
    head, scales, low, payload = parse(packet)
    per_frame = head.get("tokens_per_frame", 1)
    tokens = head.get("tokens", head["frames"] * per_frame)
    codes = take_back(coder.decode(payload, head["frames"], head["height"], head["width"]), head["model"], head["views"], tokens, per_frame)
    if head["format"] == SPLIT:
        codes = codes << 4 | unpack_array(low, 4, head["values"]).reshape(codes.shape)
    return codes.astype(np.uint8), scales


def _object(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
    """[views, tokens, width] of rows (grp, view, token, vec) with zeros for the rows that are missing, which are there, the sizes of the groups of views, and the views' numbers."""
    grp, view, token = (table.column(n).to_numpy() for n in ("grp", "view", "token"))
    (groups, numbers), i = np.unique(np.stack((grp, view)), axis=1, return_inverse=True)
    tokens, j = np.unique(token, return_inverse=True)
    i, held = i.reshape(-1), np.zeros((len(numbers), len(tokens)), bool)
    held[i, j] = True
    if held.sum() != table.num_rows:
        raise ValueError("a view has a token twice")
    vecs = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
    x = np.zeros((*held.shape, vecs.shape[1]))
    x[i, j] = vecs
    return x, held, np.unique(groups, return_counts=True)[1].tolist(), numbers.tolist()


def encoded_packets(rows: DataFrame, keys: list[str], model: str, epsilon: float, coder, split: bool = False) -> DataFrame:
    """(keys, packet) of objects, from rows (keys, grp, view, token, vec), some of which may be missing; each is decoded again, and the query fails if a code, a scale or the rows that are there have changed."""
    schema = ", ".join(f"{k} {t}" for k, t in rows.select(*keys).dtypes) + ", packet binary"

    def run(table: pa.Table) -> pa.Table:
        x, held, sizes, numbers = _object(table)
        packet = encode(x, sizes, model, epsilon, coder, split, held, numbers)
        codes, scales = decode(packet, coder)
        want, exact, _ = quantize(x, epsilon, held)
        if not (codes == want).all() or not (scales == exact).all() or not (held_rows(parse(packet)[0], x.shape[1]) == held).all():
            raise ValueError("the coder changed codes, scales or rows")
        return pa.table({**{k: table.column(k).slice(0, 1) for k in keys}, "packet": pa.array([packet], pa.binary())})

    return rows.select(*keys, "grp", "view", "token", F.col("vec").cast("array<double>").alias("vec")).groupBy(*keys).applyInArrow(run, schema)


def decoded_packets(packets: DataFrame, keys: list[str], coder) -> DataFrame:
    """(keys, view, token, scale, codes) of every row that a packet holds; tokens are numbered in the packet's order."""
    schema = ", ".join(f"{k} {t}" for k, t in packets.select(*keys).dtypes) + ", view long, token long, scale double, codes array<int>"

    def run(batches):
        for batch in batches:
            for i, packet in enumerate(batch.column(len(keys)).to_pylist()):
                head = parse(packet)[0]
                codes, scales = decode(packet, coder)
                held = held_rows(head, codes.shape[1])
                view, token = np.nonzero(held)
                n, numbers = len(view), np.array(head.get("view_numbers", range(len(scales))))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * codes.shape[2]), pa.array(codes[held].reshape(-1).astype(np.int32)))
                own = [batch.column(k).take(pa.array(np.full(n, i))) for k in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(numbers[view]), pa.array(token), pa.array(scales[view].astype(float)), lists], [*keys, "view", "token", "scale", "codes"])

    return packets.select(*keys, "packet").mapInArrow(run, schema)
