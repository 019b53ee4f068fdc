"""SimHash near-duplicates with pigeonring filtering.

The 64 bits are dealt to segments on a ring. Two fingerprints at distance d <= t
have a start from which every chain of consecutive segments stays within its
share of the budget: the first l segments differ in at most l*t/m bits. The
chain lengths whose share is below one bit must agree, so their bits are an
equi-join key, one for each start; the longer chains are checked on the joined
pair, the longest being the full Hamming check.

Only distinct fingerprints are joined; copies follow by key. A bin with more
than BIN members is not paired, but dealt on by further segments of the chain
until its bins are small, so all pairs pass the same filter, whatever the data.

Edge cases: a null, empty or blank text has the fingerprint zero and is linked
like any other; fewer words than a shingle has are one shingle; repeated rows
and ties give equal fingerprints; a null doc_id is kept, but is nobody's
component_id unless the whole component has none; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.llm.bpe import slices
from kelpie.llm.common import any_of, discard, materialize
from kelpie.llm.components import connected_components
from kelpie.llm.skew import lookup_join

BIN = 32


def fingerprint_of(text: bytes | None, words: int = 3) -> int:
    """SimHash of the shingles of whole words, repeats included; 0 without a word."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    runs = [tokens] if len(tokens) < words else zip(*(tokens[k:] for k in range(words)), strict=False)
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(s, 42) for s in map(b" ".join, runs)), dtype=">u8"))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of some big-endian unsigned 64-bit hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):  # a bounded unpacking, also for very long texts
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) of every whole text, in one pass."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                fps = np.array([fingerprint_of(t, words) for t in part.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 == 1 else mask


def ring(segments: int, bits: int = 64) -> list[int]:
    """The bit mask of each segment, as signed 64-bit integers."""
    edges = [round(i * bits / segments) for i in range(segments + 1)]
    return [_signed(((1 << b) - 1) ^ ((1 << a) - 1)) for a, b in zip(edges, edges[1:], strict=False)]


def chain_masks(segments: int, start: int) -> list[int]:
    """The mask of the chain of 1, 2, ... segments from a start."""
    masks, out, held = ring(segments), [], 0
    for k in range(segments):
        held |= masks[(start + k) % segments]
        out.append(held)
    return out


def chained(a: Column, b: Column, distance: int, segments: int, start: int, shortest: int = 1) -> Column:
    """Whether every chain of `shortest` segments or more from `start` differs within its share of the budget; the longest is the full Hamming check."""
    differ, kept = a.bitwiseXOR(b), F.lit(True)
    masks = chain_masks(segments, start)
    for length in range(shortest, segments + 1):
        kept = kept & (F.bit_count(differ.bitwiseAND(F.lit(masks[length - 1]))) <= length * distance // segments)
    return kept


def pigeonring(a: Column, b: Column, distance: int, segments: int) -> Column:
    """Whether two fingerprints pass the chains from some start: true for all that are within the distance, and for no others."""
    return any_of([chained(a, b, distance, segments, i) for i in range(segments)])


def _parts(segments: int, start: int, held: int, ways: int) -> list[int]:
    """The bits that are not held, in ring order from the start, dealt evenly to `ways` further segments; each with what is held."""
    edges = [round(i * 64 / segments) for i in range(segments + 1)]
    left = [b % 64 for b in range(edges[start], edges[start] + 64) if not held >> b % 64 & 1]
    cut = [round(i * len(left) / ways) for i in range(ways + 1)]
    return [held | sum(1 << b for b in left[x:y]) for x, y in zip(cut, cut[1:], strict=False)]


def links(nodes: DataFrame, distance: int = 2, segments: int = 5) -> DataFrame:
    """The edges (src, dst) of all pairs of distinct fingerprints fp at most `distance` apart.

    A bin is known by its start and the bits that its members share. The members
    of a large one are dealt on: at most `distance` of the bits that they need
    not share differ, so that of distance + 1 further segments one agrees. That
    is repeated until all bins are small; then no bit but a few is left to
    differ in, so the dealing ends.
    """
    if not 0 < distance < segments:
        raise ValueError("0 < distance < segments")
    shortest = math.ceil(segments / distance)  # chains below it have a budget below one bit, so their segments agree
    found = None
    keyed = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("start"), F.lit(_signed(chain_masks(segments, i)[shortest - 2])).alias("mask")) for i in range(segments)])).alias("b"))
    while True:
        keyed = keyed.select("fp", "b.start", "b.mask", F.col("fp").bitwiseAND(F.col("b.mask")).alias("key"))
        bins = materialize(keyed.groupBy("start", "mask", "key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").withColumn("size", F.col("members")), "simhash-bins")
        binned = materialize(lookup_join(keyed, bins, ["start", "mask", "key"], "members"), "simhash-binned")
        large = (F.col("size") > BIN) & (F.bit_count("mask") < 64 - distance)  # where fewer bits are left, all members are within the distance
        small = binned.filter(~large)
        left, right = (small.select("start", "mask", "key", F.col("fp").alias(x)) for x in ("src", "dst"))
        passed = any_of([(F.col("start") == i) & chained(F.col("src"), F.col("dst"), distance, segments, i, shortest) for i in range(segments)])
        pairs = left.join(right, ["start", "mask", "key"]).filter(F.col("src") < F.col("dst")).filter(passed).select("src", "dst")
        found = pairs if found is None else found.unionByName(pairs)
        hot = {(r["start"], r["mask"] & (1 << 64) - 1) for r in bins.filter(large).select("start", "mask").distinct().collect()}  # of the masks of this step, whose number the data cannot raise
        discard(bins)
        if not hot:
            return found.distinct()
        dealt = [(i, _signed(m), _signed(x)) for i, m in sorted(hot) for x in _parts(segments, i, m, distance + 1)]
        further = nodes.sparkSession.createDataFrame(dealt, "start int, mask long, finer long")
        some = binned.filter(large).join(F.broadcast(further), ["start", "mask"])
        keyed = some.select("fp", F.struct("start", F.col("finer").alias("mask")).alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 2, segments: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): 16 hexadecimal digits, and the smallest doc_id reachable over links."""
    fps = materialize(fingerprints(docs, words, id_col, text_col), "simhash")
    nodes = materialize(fps.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")), "simhash-nodes")
    roots = connected_components(links(nodes.select("fp"), distance, segments))  # only of fingerprints that have a link
    named = named_by_root(nodes, roots, "fp")
    out = lookup_join(fps, named, ["fp"], "n")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def named_by_root(nodes: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """(node, n, component_id): of every node (its rows n, its least value) the least value of its component; roots (node, root) has the nodes with a link."""
    rooted = nodes.join(roots.withColumnRenamed("node", node), node, "left")
    linked = materialize(rooted.filter("root is not null"), "rooted")
    least = linked.groupBy("root").agg(F.min("least").alias("reached"), F.count(F.lit(1)).alias("held"))
    named = lookup_join(linked.select(node, "n", "root"), materialize(least, "rooted-least"), ["root"], "held").select(node, "n", F.col("reached").alias("component_id"))
    return named.unionByName(rooted.filter("root is null").select(node, "n", F.col("least").alias("component_id")))
