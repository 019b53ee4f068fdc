"""BPE encoding and decoding with a pair occurrence index.

All pieces that a batch has and the cache lacks are laid out in one symbol
sequence. An index maps every mergeable pair to all its positions there; the
active ranks are applied in ascending order, each to its whole list of
positions, and the lists of the neighbouring pairs are updated. A piece is
encoded once, however often it occurs.

Edge cases: a null or empty text has no ids (the digest of nothing, decoded to
the empty text); a null doc_id is passed through; rows are never merged, so
repeated rows give repeated results; very long texts are encoded whole; other
columns, whatever their names, are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds of the piece cache of a worker, of the symbols merged at once and of the texts encoded at once (a longer text stands alone).
CACHE_PIECES, MERGE_SYMBOLS, SLICE_BYTES = 250_000, 1 << 20, 1 << 20
#: A list of fewer positions is applied one by one, a longer one at a stroke.
FEW = 24


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, by the public rule: printable Latin-1 as itself, the others from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: Code points beyond the basic plane; texts without any, nearly all, take a pattern whose classes are looked up in one step.
_BEYOND = re.compile("[\U00010000-\U0010ffff]")


@lru_cache(2)
def piece_pattern(beyond: bool) -> re.Pattern:
    """The public byte-level pre-tokenization pattern, with explicit classes (Unicode L, N and White_Space) so that the fast standard engine can run it."""
    every = "".join(chr(c) for c in range(sys.maxunicode + 1 if beyond else 0x10000) if not 0xD800 <= c <= 0xDFFF)
    spans = {k: [(ord(m[0][0]), ord(m[0][-1])) for m in regex.finditer(rf"\p{{{k}}}+", every)] for k in "LN"}
    letter, number = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans[k]) for k in "LN")
    space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def split_pieces(text: str) -> list[str]:
    return piece_pattern(bool(_BEYOND.search(text))).findall(text)


class PairIndexBpe:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.bytes_of: dict[int, bytes] = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items()}
        single = {b[0]: i for i, b in self.bytes_of.items() if len(b) == 1}
        self.start = np.array([single[b] for b in range(256)], dtype=np.int64)
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        self.parts: list[int] = []
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            key = vocab[a] << 20 | vocab[b]
            self.rank.setdefault(key, r)
            self.merged.append(vocab[a + b])
            self.parts.append(key)
        self.keys = np.array(sorted(self.rank), dtype=np.int64)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t, i in self.added.items():
            self.bytes_of[i] = t.encode()
        self.split_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        of = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.flat = np.frombuffer(b"".join(of), dtype=np.uint8)
        self.length = np.array([len(x) for x in of], dtype=np.int64)
        self.place = np.cumsum(self.length) - self.length
        self.cache: dict[str, bytes] = {}

    def merge(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        some: list[bytes] = []
        held = 0
        for raw in (p.encode("utf-8", "surrogatepass") for p in pieces):
            some.append(raw)
            held += len(raw)
            if held >= MERGE_SYMBOLS:
                out += self._merge(some)
                some, held = [], 0
        return out + (self._merge(some) if some else [])

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        ends = np.cumsum(lengths)
        first = self.start[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        n = len(first)
        last = np.zeros(n, dtype=bool)
        last[ends[lengths > 0] - 1] = True
        # The index: every pair that has a rank, with all its positions in ascending order.
        at = np.flatnonzero(~last[:-1]) if n > 1 else np.empty(0, dtype=np.int64)
        keys = first[at] << 20 | first[at + 1]
        known = np.searchsorted(self.keys, keys)
        known[known == len(self.keys)] = 0
        keep = self.keys[known] == keys
        at, keys = at[keep], keys[keep]
        order = np.argsort(keys, kind="stable")
        at, keys = at[order], keys[order]
        cut = np.flatnonzero(np.diff(keys)) + 1
        places: dict[int, list] = {int(g[0]): [p] for g, p in zip(np.split(keys, cut), np.split(at, cut), strict=True)} if len(keys) else {}
        rank, merged, parts = self.rank, self.merged, self.parts
        active = [rank[k] for k in places]
        heapq.heapify(active)
        sym = first.astype(np.int32)
        # The gap to the next and to the previous live symbol; 0 at a piece's edge.
        right = (~last).astype(np.int32)
        left = np.zeros(n, dtype=np.int32)
        left[1:] = ~last[:-1]
        pop, push = heapq.heappop, heapq.heappush

        def listed(key: int, spots: np.ndarray | list[int]) -> None:
            if key in places:
                places[key].append(spots)
            else:
                places[key] = [spots]
                push(active, rank[key])

        while active:
            pair = parts[pop(active)]
            found = places.pop(pair, None)
            if found is None:
                continue
            a, b, new = pair >> 20, pair & 0xFFFFF, merged[rank[pair]]
            if sum(map(len, found)) < FEW or a == b:  # `aaa` needs its merges one after the other
                for p in sorted({int(p) for spots in found for p in spots}):
                    gap = int(right[p])
                    if sym[p] != a or not gap or sym[p + gap] != b:
                        continue  # a merge nearby has taken one of the two
                    q = p + gap
                    sym[p], sym[q] = new, -1
                    gap = int(right[q])
                    if gap:
                        s = q + gap
                        right[p], left[s] = s - p, s - p
                        if (key := new << 20 | int(sym[s])) in rank:
                            listed(key, [p])
                    else:
                        right[p] = 0
                    gap = int(left[p])
                    if gap and (key := int(sym[p - gap]) << 20 | new) in rank:
                        listed(key, [p - gap])
                continue
            p = np.concatenate(found) if len(found) > 1 else np.asarray(found[0])
            gap = right[p]
            p = p[(sym[p] == a) & (gap > 0) & (sym[p + gap] == b)]
            if not len(p):
                continue
            q = p + right[p]
            sym[p], sym[q] = new, -1
            gap = right[q]
            inner = gap > 0
            s, o = (q + gap)[inner], p[inner]
            right[p] = 0
            right[o] = left[s] = s - o
            gap = left[p]
            o2 = (p - gap)[gap > 0]
            keys = np.concatenate((new << 20 | sym[s].astype(np.int64), sym[o2].astype(np.int64) << 20 | new))
            spots = np.concatenate((o, o2))
            known = np.searchsorted(self.keys, keys)
            known[known == len(self.keys)] = 0
            keep = self.keys[known] == keys
            keys, spots = keys[keep], spots[keep]
            if len(keys):
                order = np.argsort(keys)
                keys, spots = keys[order], spots[order]
                cut = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
                for i, j in zip(cut, cut[1:], strict=False):
                    listed(int(keys[i]), spots[i:j])
        alive = sym >= 0
        counts = np.concatenate(([0], np.cumsum(alive)))
        ids = sym[alive].astype("<u4").tobytes()
        stops = (counts[ends] * 4).tolist()
        starts = (counts[ends - lengths] * 4).tolist()
        return [ids[i:j] for i, j in zip(starts, stops, strict=True)]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Of each text the ids as little-endian unsigned 32-bit integers; null is the empty text."""
        find, cache = split_pieces, self.cache
        pieces = []
        for text in texts:
            parts = []
            if text:
                if self.split_added and any(t in text for t in self.added):
                    for k, part in enumerate(self.split_added.split(text)):
                        parts += [part] if k % 2 else find(part)
                else:
                    parts = find(text)
            pieces.append(parts)
        seen: set[str] = set()
        for parts in pieces:
            seen.update(parts)
        new = [p for p in seen if p not in cache]
        if len(cache) + len(new) > CACHE_PIECES and cache:
            cache.clear()
            new = list(seen)
        whole = [p for p in new if p in self.added]
        for p in whole:
            cache[p] = self.added[p].to_bytes(4, "little")
        rest = [p for p in new if p not in self.added] if whole else new
        cache.update(zip(rest, self.merge(rest), strict=True))
        get = cache.__getitem__
        return [b"".join(map(get, parts)) for parts in pieces]

    def decode_batch(self, encoded: list[bytes]) -> list[bytes]:
        """The bytes of each text; see decode() for those that are not UTF-8."""
        ids = np.frombuffer(b"".join(encoded), dtype="<u4")
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        places = np.repeat(self.place[ids] - ends + lengths, lengths)
        places += np.arange(len(places))
        flat = self.flat[places].tobytes()
        stops = np.concatenate(([0], ends))[np.cumsum([len(x) // 4 for x in encoded])].tolist() if encoded else []
        return [flat[i:j] for i, j in zip([0, *stops], stops, strict=False)]

    def decode(self, ids: bytes) -> str:
        return self.decode_batch([ids])[0].decode("utf-8", "replace")


@lru_cache(2)
def load(path: str) -> PairIndexBpe:
    return PairIndexBpe(path)


def slices(batch: pa.RecordBatch, column: int = 1, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of at most about `most` bytes of the given text or binary column; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row; vocabulary is the path of the file on driver and executors."""

    def run(batches):
        bpe = load(vocabulary)
        for batch in batches:
            for part in slices(batch, most=SLICE_BYTES):
                ids = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in bpe.encode_batch(part.column(1).to_pylist())]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                values = np.concatenate(ids) if ids else np.empty(0, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from arrays of ids; null ids give the empty text."""

    def run(batches):
        bpe = load(vocabulary)
        for batch in batches:
            texts = [x.decode("utf-8", "replace") for x in bpe.decode_batch([np.array(x or [], dtype="<u4").tobytes() for x in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every whole text: (doc_id, n_tokens, ids_sha256, decoded_sha256). One pass, no shuffle."""

    def run(batches):
        bpe = load(vocabulary)
        for batch in batches:
            for part in slices(batch, most=SLICE_BYTES):
                encoded = bpe.encode_batch(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(x) // 4 for x in encoded], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in encoded], pa.string()),
                        pa.array([hashlib.sha256(x.decode("utf-8", "replace").encode()).hexdigest() for x in bpe.decode_batch(encoded)], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
