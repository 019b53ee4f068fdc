"""Sorted-string-table shards of token ids.

A file holds documents in ascending order of their identifier:

    magic
    data blocks       entries with prefix-compressed keys, restart points, a checksum
    index block       for each data block its last key, offset and length
    Bloom filter      over the keys
    properties        JSON: rows, tokens, smallest and largest key
    footer            offsets and lengths of index, filter and properties, magic

Looking up a key asks the filter, searches the index by bisection, then the
restart points of one block, and reads no other block (equal keys may run on
into the next).

An entry is: shared key length, own key length, value length (varints), own key
bytes, value. A value is the ids as little-endian integers of the file's width,
compressed by zstd where that is shorter (first byte 1, else 0). A key is 0x00
for null, else 0x01 and the identifier's 8 bytes, big-endian with the sign bit
flipped, so that byte order is the order of identifiers with null first.

Edge cases: a null or empty text holds only the end id; repeated identifiers are
kept, ordered by a hash of their text, and may run on into the next file; an empty table makes no files; a long text is
one long entry; other columns are not read.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.llm.bpe import slices
from kelpie.llm.common import partitions, scratch_path
from kelpie.llm.ranges import place_in, ranges_of

MAGIC = b"KELPSST1"
FOOTER = struct.Struct("<6Q8s")
BLOCK_BYTES, RESTART_EVERY, BLOOM_BITS, BLOOM_HASHES = 64 << 10, 16, 10, 7
#: Bound of a worker's cache of encoded runs and parts; ASCII punctuation.
CACHE_CHUNKS = 1_000_000
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


class Block:
    """Builds one block."""

    def __init__(self):
        self.parts, self.restarts, self.size, self.rows, self.last = [], [], 0, 0, b""

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.rows % RESTART_EVERY:
            shared = len(os.path.commonprefix([self.last, key]))
        else:
            self.restarts.append(self.size)
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.parts.append(entry)
        self.size += len(entry)
        self.rows += 1
        self.last = key

    def finish(self) -> bytes:
        body = b"".join(self.parts) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts))
        return body + struct.pack("<I", zlib.crc32(body))


def _entries(block: bytes, start: int = 0) -> Iterator[tuple[bytes, bytes]]:
    """Entries from a restart point on."""
    (restarts,) = struct.unpack_from("<I", block, len(block) - 8)
    end, key, at = len(block) - 8 - 4 * restarts, b"", start
    while at < end:
        shared, at = _read_varint(block, at)
        own, at = _read_varint(block, at)
        size, at = _read_varint(block, at)
        key = key[:shared] + block[at : at + own]
        at += own
        yield key, block[at : at + size]
        at += size


def _seek(block: bytes, key: bytes) -> int:
    """The offset of the last restart point whose key is below `key`, or 0."""
    (n,) = struct.unpack_from("<I", block, len(block) - 8)
    offsets = struct.unpack_from(f"<{n}I", block, len(block) - 8 - 4 * n)

    def at(offset: int) -> bytes:
        return next(_entries(block, offset))[0]

    return offsets[max(0, bisect.bisect_left(offsets, key, key=at) - 1)] if n else 0


def _bloom_places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Writes one file; keys must come in ascending order."""

    def __init__(self, sink, width: int):
        self.sink, self.width, self.at = sink, width, 0
        self.block, self.index, self.keys = Block(), [], []
        self.rows = self.tokens = 0
        self.first = self.last = b""
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self._put(MAGIC)

    def _put(self, data: bytes) -> tuple[int, int]:
        self.sink.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        key = key_of(doc_id)
        if self.rows and key < self.last:
            raise ValueError("keys must ascend")
        packed = self.pack(ids)
        self.block.add(key, b"\x01" + packed if len(packed) < len(ids) else b"\x00" + ids)
        if not self.keys or key != self.last:
            self.keys.append(key)
        self.first = self.first or key
        self.last = key
        self.rows += 1
        self.tokens += len(ids) // self.width
        if self.block.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block.rows:
            last = self.block.last
            self.index.append((last, *self._put(self.block.finish())))
            self.block = Block()

    def close(self) -> dict:
        self._flush()
        index = Block()
        for key, offset, length in self.index:
            index.add(key, struct.pack("<QQ", offset, length))
        bits = max(64, BLOOM_BITS * len(self.keys) + 7 & ~7)
        bloom = np.zeros(bits, dtype=bool)
        for key in self.keys:
            bloom[_bloom_places(key, bits)] = True
        about = {"rows": self.rows, "tokens": self.tokens, "width": self.width, "first": self.first.hex(), "last": self.last.hex()}
        where = [self._put(index.finish()), self._put(np.packbits(bloom, bitorder="little").tobytes()), self._put(json.dumps(about).encode())]
        self._put(FOOTER.pack(*(x for pair in where for x in pair), MAGIC))
        return about


class Reader:
    """Reads a file through any object with size(), seek() and read()."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        *where, magic = FOOTER.unpack(self._get(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a table of this format")
        self.about = json.loads(self._get(*where[4:6]))
        self.bloom = self._get(*where[2:4])
        self.index = [(k, *struct.unpack("<QQ", v)) for k, v in _entries(self._checked(*where[0:2]))]
        self.unpack = zstandard.ZstdDecompressor().decompress
        self.blocks_read = 0

    def _get(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def _checked(self, offset: int, length: int) -> bytes:
        block = self._get(offset, length)
        if zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
            raise ValueError("a block's checksum differs")
        return block[:-4] + block[-4:]

    def _value(self, value: bytes) -> bytes:
        return self.unpack(value[1:]) if value[0] else value[1:]

    def may_hold(self, doc_id: int | None) -> bool:
        bits = len(self.bloom) * 8
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key_of(doc_id), bits))

    def get(self, doc_id: int | None) -> list[bytes]:
        """The ids of every entry with this identifier."""
        key, out = key_of(doc_id), []
        if not self.index or not self.may_hold(doc_id):
            return out
        for _, offset, length in self.index[bisect.bisect_left(self.index, key, key=lambda x: x[0]) :]:
            block = self._checked(offset, length)
            self.blocks_read += 1
            for k, v in _entries(block, _seek(block, key)):
                if k == key:
                    out.append(self._value(v))
                elif k > key:
                    return out
        return out

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        for _, offset, length in self.index:
            for k, v in _entries(self._checked(offset, length)):
                yield id_of(k), self._value(v)


class ChunkEncoder:
    """The ids of the tokenizers library for vocabularies that drop white space and lower the case.

    No piece of such a text spans white space, nor the place between a letter
    and the punctuation that ends a run, so the library encodes every distinct
    run (lower-cased in A-Z) without its last punctuation, and every distinct
    last punctuation, once. They go to it many at a time, divided by a special
    token, which it splits off before all else. Runs with a special token in
    them go to it alone and unchanged.
    """

    def __init__(self, vocabulary: str, divider: str, width: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.divider, self.divider_id = divider, self.tokenizer.token_to_id(divider)
        tokens = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.any_special = re.compile(b"|".join(map(re.escape, tokens)), re.I)
        self.lead = re.match(b"[^A-Za-z]*", os.path.commonprefix(tokens))[0]  # a quick look at what has no case
        self.dtype = np.dtype(f"<u{width}")
        self.cache: dict[bytes, bytes] = {}

    def _encode(self, parts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        size = self.dtype.itemsize
        for i in range(0, len(parts), 1024):
            some = parts[i : i + 1024]
            text = self.divider.join([c.decode() for c in some])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)
            at = (np.flatnonzero(ids == self.divider_id) * size).tolist()
            if len(at) != len(some) - 1:
                raise RuntimeError("the divider was not split off")
            raw = ids.tobytes()
            for c, a, b in zip(some, [0, *(x + size for x in at)], [*at, len(raw)], strict=True):
                yield c, raw[a:b]

    def special(self, text: bytes) -> bool:
        return self.lead in text and self.any_special.search(text) is not None

    def _learn(self, runs: set[bytes]) -> None:
        """Puts the ids of some runs without special tokens into the cache."""
        ends: list[tuple[bytes, bytes, bytes]] = []
        parts: set[bytes] = set()
        for c in runs:
            if c[-1] not in PUNCTUATION:
                parts.add(c)
                continue
            core = c.rstrip(PUNCTUATION)
            if not core or not (97 <= core[-1] <= 122 or core.decode()[-1].lower()[-1].isalpha()):
                parts.add(c)
            else:
                ends.append((c, core, c[len(core) :]))
        for _, core, tail in ends:
            parts.add(core)
            parts.add(tail)
        cache = self.cache
        cache.update(self._encode([p for p in parts if p not in cache]))
        for c, core, tail in ends:
            cache[c] = cache[core] + cache[tail]

    def encode_batch(self, texts: list[bytes | None]) -> list[bytes]:
        special, cache = self.special, self.cache
        split = [t.lower().split() if t and not special(t) else (t or b"").split() for t in texts]
        seen: set[bytes] = set()
        for words in split:
            seen.update(words)
        alone: dict[bytes, bytes] = {}
        if any(special(t) for t in texts if t):
            for c in [c for c in seen if special(c)]:
                seen.discard(c)
                alone[c] = np.array(self.tokenizer.encode(c.decode(), add_special_tokens=False).ids, dtype=self.dtype).tobytes()
        new = seen.difference(cache)
        if len(cache) + len(new) > CACHE_CHUNKS and cache:
            cache.clear()
            new = seen
        self._learn(new)
        if alone:
            cache = cache | alone
        get = cache.__getitem__
        return [b"".join(map(get, words)) for words in split]


@lru_cache(2)
def _encoder(vocabulary: str, divider: str, width: int) -> ChunkEncoder:
    return ChunkEncoder(vocabulary, divider, width)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_tables(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 1, divider: str = "<|endoftext|>", width: int = 2, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> list[dict]:
    """Encodes every whole text, appends end_id and writes the tables under `folder`; returns a line for each file, ascending.

    width is the bytes of an id: 2 for vocabularies of up to 65,536; files is the
    least number of files. The shuffle carries ids only. A file's name is new with every attempt, and only files of
    attempts that ended well are in the list, so that a lost executor or a
    second attempt leaves nothing that is read.
    """
    spark = docs.sparkSession
    ids = F.col(id_col).cast("long")
    docs = docs.select(ids.alias("doc_id"), F.coalesce(ids, F.lit(-(1 << 63))).alias("key"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tie"), F.col(text_col).cast("binary").alias("text"))
    bounds = ranges_of(docs, files or partitions(spark))
    end = end_id.to_bytes(width, "little")

    def encode(batches):
        encoder = _encoder(vocabulary, divider, width)
        for batch in batches:
            for part in slices(batch, column=3):
                ids = [x + end for x in encoder.encode_batch(part.column(3).to_pylist())]
                places = place_in(bounds, part.column(1).to_numpy(), part.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(ids, pa.binary()), pa.array(places)], ["doc_id", "tie", "ids", "place"])

    def write(batches):
        system, base = file_system(folder)
        writer = sink = None
        place, done = None, []

        def finish():
            about = writer.close()
            sink.close()
            done.append((place, name, about["rows"], about["tokens"]))

        for batch in batches:
            columns = (batch.column(k).to_pylist() for k in range(3))
            for doc_id, ids, at in zip(*columns, strict=True):
                if at != place:
                    if writer:
                        finish()
                    place, name = at, f"{at:06d}-{uuid.uuid4().hex}.sst"
                    sink = system.open_output_stream(f"{base}/{name}")
                    writer = Writer(sink, width)
                writer.add(doc_id, ids)
        if writer:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [[]] * 4, (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["place", "file", "n_rows", "tokens"])

    system, base = file_system(folder)
    system.create_dir(base, recursive=True)
    encoded = docs.mapInArrow(encode, "doc_id long, tie long, ids binary, place int")
    ordered = encoded.repartition(max(partitions(spark), len(bounds)), "place").sortWithinPartitions("place", F.col("doc_id").asc_nulls_first(), "tie").select("doc_id", "ids", "place")
    lines = ordered.mapInArrow(write, "place int, file string, n_rows long, tokens long").collect()  # one line for each file
    out, start = [], 0
    for r in sorted(lines, key=lambda r: r["place"]):
        out.append({"file": f"{folder}/{r['file']}", "start": start, "rows": r["n_rows"], "tokens": r["tokens"]})
        start += r["tokens"]
    return out


def read_tables(spark, lines: list[dict], width: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of write_tables(), which must still be there when the frame is used."""

    def read(batches):
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, path = file_system(uri)
                with system.open_input_file(path) as source:
                    rows = []
                    for doc_id, raw in Reader(source):
                        ids = np.frombuffer(raw, dtype=f"<u{width}").astype("<u4")
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield _lines(rows)
                            rows = []
                    yield _lines(rows)

    frame = spark.createDataFrame([(x["file"], x["start"]) for x in lines], "file string, start long")
    return frame.repartition(max(1, len(lines))).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _lines(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names)


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 1) -> DataFrame:
    """Writes documents in ascending doc_id order to tables in the shared folder and reads them back."""
    spark = docs.sparkSession
    return read_tables(spark, write_tables(docs, scratch_path(spark, "sst"), vocabulary, end_id))
