"""Document fingerprints from closed syncmers.

A k-mer of code points is chosen if the smallest hash of its inner s-mers is the
first or the last of them. Whether it is chosen depends on its own k code points
alone, so the anchors of an unchanged passage stay the same wherever it stands
and whatever surrounds it, and at least one in k - s + 1 neighbours is chosen.

The fingerprint lists all anchors in the order of the text: of each the distance
from the one before (at most 16, as k - s + 1 is; one hexadecimal digit, less
one) and 24 bits of its hash (six digits). So it holds every anchor's position.

Two fingerprints are matched by position: the i-th occurrence of a hash in one
belongs to its i-th in the other, and of these matches the longest chain that
ascends in both texts counts. The likeness is the chain's share of the anchors
that either text has (chain / (a + b - chain)): passages that stand in another
order are not all in the chain, passages that moved together are.

Edge cases: a null text is the empty one, whose fingerprint is the empty string
(likeness 1 to itself, 0 to all others); any other text without a
closed syncmer (shorter than k, or not much longer) is one anchor as a whole;
repeated rows are kept, and ties of doc_id are ordered by a hash of the text; a
null doc_id comes first; the only row is its own next; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.llm.bpe import slices
from kelpie.llm.common import partitions
from kelpie.llm.ranges import place_of, ranges_of

K, S = 20, 5
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _M2
    x = (x ^ x >> np.uint64(29)) * _M1
    return x ^ x >> np.uint64(32)


def _windows(x: np.ndarray, width: int, step) -> np.ndarray:
    """step(all of a window) by doubling, for associative, overlapping-safe steps (minimum)."""
    have = 1
    while have * 2 <= width:
        x = step(x[:-have], x[have:])
        have *= 2
    return step(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def _grams(code: np.ndarray, width: int) -> np.ndarray:
    """A hash of every window of `width` code points."""
    out = np.zeros(len(code) - width + 1, dtype=np.uint64)
    for j in range(width):
        out *= _M1
        out += code[j : j + len(out)]
    return _mix(out)


def anchors(code: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the closed syncmers of an array of code points and their 64-bit hashes."""
    if len(code) < k:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    inner = _grams(code, s)
    least = _windows(inner, k - s + 1, np.minimum)
    at = np.flatnonzero((inner[: len(least)] == least) | (inner[k - s :] == least))
    hashes = np.zeros(len(at), dtype=np.uint64)
    for j in range(k):
        hashes *= _M2
        hashes += code[at + j]
    return at, _mix(hashes)


_DIGITS = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)


class Anchors:
    """The anchors of one text: their positions and 24-bit hashes, in the order of the text."""

    __slots__ = ("at", "hashes")

    def __init__(self, at: np.ndarray, hashes: np.ndarray):
        self.at, self.hashes = at, hashes

    def __len__(self) -> int:
        return len(self.at)


def all_anchors(texts: list[str], k: int = K, s: int = S) -> list[Anchors]:
    """The anchors of each text."""
    if k - s + 1 > 16:
        raise ValueError("a distance of anchors must fit into a hexadecimal digit")
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    lengths = np.array([len(r) // 4 for r in raw], dtype=np.int64)
    ends = np.cumsum(lengths)
    code = np.frombuffer(b"".join(raw), dtype="<u4").astype(np.uint64)
    at, hashes = anchors(code, k, s)
    doc = np.searchsorted(ends, at, side="right")
    inside = at + k <= ends[doc] if len(at) else np.empty(0, dtype=bool)
    doc, at, hashes = doc[inside], at[inside] - (ends - lengths)[doc[inside]], (hashes[inside] >> np.uint64(40)).astype(np.uint32)
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    found = [Anchors(at[i:j], hashes[i:j]) for i, j in zip(cut, cut[1:], strict=False)]
    for i, f in enumerate(found):
        if not len(f) and lengths[i]:
            found[i] = Anchors(np.zeros(1, dtype=np.int64), np.array([xxhash.xxh32_intdigest(raw[i]) >> 8], dtype=np.uint32))
    return found


def _occurrences(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes with the number of their occurrence, ascending, and where each stands."""
    order = np.argsort(hashes, kind="stable")
    sorted_hashes = hashes[order]
    first = np.concatenate(([0], np.flatnonzero(np.diff(sorted_hashes)) + 1))
    number = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return sorted_hashes.astype(np.uint64) << np.uint64(32) | number.astype(np.uint64), order


def ascending(places: np.ndarray) -> int:
    """The length of the longest ascending chain."""
    if len(places) < 2 or (places[1:] > places[:-1]).all():
        return len(places)
    ends: list[int] = []
    for x in places.tolist():
        if not ends or x > ends[-1]:
            ends.append(x)
        else:
            ends[bisect.bisect_left(ends, x)] = x
    return len(ends)


def likeness(a: Anchors, b: Anchors) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) == len(b) and (a.hashes == b.hashes).all():
        return 1.0
    (x, at_a), (y, at_b) = _occurrences(a.hashes), _occurrences(b.hashes)
    place = np.searchsorted(y, x)
    place[place == len(y)] = 0
    same = y[place] == x
    order = np.argsort(at_a[same])
    chain = ascending(at_b[place[same]][order])
    return chain / (len(a) + len(b) - chain)


def show(found: Anchors) -> str:
    if not len(found):
        return ""
    digits = np.empty((len(found), 7), dtype=np.uint8)
    digits[:, 0] = np.diff(found.at, prepend=-1) - 1
    for j in range(6):
        digits[:, 1 + j] = found.hashes >> np.uint32(20 - 4 * j) & np.uint32(15)
    return _DIGITS[digits].tobytes().decode()


def read(fingerprint: str) -> Anchors:
    """The anchors that a fingerprint shows."""
    digits = np.frombuffer(bytes.fromhex("0" + "0".join(fingerprint)), dtype=np.uint8).reshape(-1, 7).astype(np.int64) if fingerprint else np.empty((0, 7), dtype=np.int64)
    return Anchors(np.cumsum(digits[:, 0] + 1) - 1, (digits[:, 1:] << np.arange(20, -4, -4)).sum(axis=1).astype(np.uint32))


def fingerprints(docs: DataFrame, k: int = K, s: int = S, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every whole text, in one pass."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, most=2 << 20):
                found = all_anchors([t or "" for t in part.column(1).to_pylist()], k, s)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([show(x) for x in found], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def edit(text: str, following: str) -> str:
    """The text with its last quarter (rounded down) replaced by as many first code points of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame, k: int = K, s: int = S, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints every text, its edited text and compares them, also with the next document's; the contract's digest.

    Documents are dealt to ranges of doc_id by one shuffle, in which the first
    document of each range is also copied to the end of the range before, which
    then needs no other. A doc_id with far more rows than a range should have is
    dealt on by the hash of the text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.xxhash64("text").alias("tie"))
    bounds = ranges_of(keyed, 4 * partitions(spark))
    if not len(bounds):
        return spark.createDataFrame([], SCHEMA)
    # A range begins with a row, or with all rows of a key, of which the first counts. The range before the first one is the last.
    none = -(1 << 63)
    copies = [(int(key), None if tie == none else int(tie), (p - 1) % len(bounds)) for p, (key, tie) in enumerate(bounds)]
    copied = F.broadcast(spark.createDataFrame(copies, "k long, t long, before int"))  # a line for each range
    both = keyed.withColumn("place", place_of(bounds)("key", "tie")).join(copied, (F.col("key") == F.col("k")) & (F.col("t").isNull() | (F.col("tie") == F.col("t"))), "left")
    own, copy = F.struct("place", F.lit(0).alias("edge")), F.struct(F.col("before").alias("place"), F.lit(1).alias("edge"))
    rows = both.select("doc_id", "text", "key", "tie", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("to")).select("doc_id", "text", "key", "tie", "to.place", "to.edge")
    ordered = rows.repartition(max(partitions(spark), len(bounds) // 4), "place").sortWithinPartitions("place", "edge", "key", "tie").select("doc_id", "text", "edge")

    def run(batches):
        held: list[tuple] = []

        def compare(rows: list[tuple]) -> pa.RecordBatch:
            """Of all rows but the last, which is only looked at."""
            texts = [t for _, t, _ in rows]
            own = [i for i in range(len(rows) - 1) if not rows[i][2]]
            changed = [edit(texts[i], texts[i + 1]) for i in own]
            found = all_anchors(texts + changed, k, s)
            plain, edited = found[: len(texts)], found[len(texts) :]
            columns = [
                pa.array([rows[i][0] for i in own], pa.int64()),
                pa.array([len(texts[i]) for i in own], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                pa.array([show(plain[i]) for i in own], pa.string()),
                pa.array([show(x) for x in edited], pa.string()),
                pa.array([likeness(plain[i], x) for i, x in zip(own, edited, strict=True)], pa.float64()),
                pa.array([likeness(plain[i], plain[i + 1]) for i in own], pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            for part in slices(batch, most=2 << 20):
                rows = held + list(zip(*(part.column(c).to_pylist() for c in range(3)), strict=True))
                yield compare(rows)
                held = rows[-1:]
        if held and not held[0][2]:
            raise RuntimeError("a range ends without the document that follows it")

    return ordered.mapInArrow(run, SCHEMA)
