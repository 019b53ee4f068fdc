"""Near copies by shingle sets: the setting of SimHash near-duplicates for looser copies.

Two texts are near copies if their sets of SHINGLE-word shingles have a Jaccard
index of ALIKE at least. The SimHash fingerprints of such sets lie about a sixth
of their bits apart, where the segments of pigeonring that must agree are too
short to be join keys. So candidates share a key of ROWS least hashes, one of
BANDS (a pair at ALIKE does with probability 1 - (1 - ALIKE**ROWS)**BANDS, 0.9996,
a closer one more surely); the pigeonring filter and the full Hamming check on
fingerprints of the same shingles (DISTANCE of 64 bits, five deviations above the
mean of a pair at ALIKE) prune them, and the sets themselves decide.

Texts with the same set are one node. The nodes of bins beyond BIN are held
against a few pivots, each in the largest of its bins, and those that are then
outside a bin's largest component against more pivots from it. What is linked is
one component, and after that only nodes of different components are candidates: all of a
small bin, and in a large one those outside its largest component with all others.
Pairs within a component change nothing, so the components are those of all
pairs, without pairing a group of near copies with itself. In large bins, where
texts that share a passage meet, fingerprints of WIDE words are compared too:
WIDE_DISTANCE of their bits is three and a half deviations above the mean of a pair at ALIKE
(of sets of at least LEAST shingles; smaller ones pass), and tells 0.8 from 0.7.

Edge cases: a null, empty or blank text has the empty set and is a copy of its
like only; fewer words than a shingle has are one shingle; rows are known by
doc_id and text, so other texts under one doc_id, or without one, are judged
each; of rows that repeat both, one stays; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.llm.bpe import slices
from kelpie.llm.common import broadcast_small, discard, matching, materialize, text_hash, without
from kelpie.llm.components import connected_components
from kelpie.llm.simhash import majority, named_by_root, pigeonring
from kelpie.llm.skew import lookup_join
from kelpie.llm.syncmers import _mix

SHINGLE, ALIKE = 5, 0.8
BANDS, ROWS = 20, 5
DISTANCE, SEGMENTS = 24, 3
WIDE, WIDE_DISTANCE, LEAST = 32, 362, 10
BIN, PIVOTS = 32, 4
#: Pivots of a large bin's largest component that the nodes outside are held against after each round; in the end none.
MORE_PIVOTS = (16, 0)
_M = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles_of(text: bytes | None, words: int = SHINGLE) -> np.ndarray:
    """The hashes of the distinct shingles of whole words, ascending."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    word = np.fromiter(map(xxhash.xxh64_intdigest, tokens), dtype=np.uint64, count=len(tokens))
    width = min(words, len(tokens))
    out = np.zeros(len(word) - width + 1, dtype=np.uint64)
    for j in range(width):
        out *= _M
        out += word[j : j + len(out)]
    return np.unique(_mix(out))


def bands_of(sets: list[np.ndarray]) -> np.ndarray:
    """BANDS keys of each set, none of them empty."""
    values = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.zeros((len(sets), BANDS), dtype=np.uint64)
    for i, factor in enumerate(_FACTORS):
        out[:, i // ROWS] = out[:, i // ROWS] * _M + _mix(np.minimum.reduceat(values * factor, starts))
    return _mix(out + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


_WIDE_FACTORS = np.random.default_rng(6).integers(0, 1 << 63, WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A byte's bits as the lowest bits of the eight bytes of a 64-bit integer.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of WIDE words, whose bits come from as many further hashes of each shingle."""
    ones = np.zeros(WIDE * 64, dtype=np.int64)
    for i in range(0, len(hashes), 255):  # as many as a byte can count
        raw = _mix(hashes[i : i + 255, None] * _WIDE_FACTORS).view(np.uint8)
        ones += _LANES[raw].sum(axis=0).view(np.uint8)
    return np.packbits(ones * 2 > len(hashes)).view(np.int64)


SIGNATURES = "row long, doc_id long, copy long, fp long, key long, n int, shingles array<int>, bands array<long>"


def _lists(values: list[np.ndarray], kind) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values), kind))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every whole text a row number, the hash of the text, of its shingles the SimHash, the hash of the set, its size, its members (as 32-bit hashes) and its bands, in one pass."""

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, column=2, most=1 << 20):
                sets = [shingles_of(t) for t in part.column(2).to_pylist()]
                bands = np.zeros((len(sets), BANDS), dtype=np.int64)
                full = [k for k, s in enumerate(sets) if len(s)]
                if full:
                    bands[full] = bands_of([sets[k] for k in full])
                none = np.empty(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + len(sets))),
                        part.column(0),
                        part.column(1),
                        pa.array(np.array([majority(s.astype(">u8")) for s in sets], dtype=np.uint64).view(np.int64)),
                        pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)),
                        pa.array([len(s) for s in sets], pa.int32()),
                        _lists([np.unique((s >> np.uint64(32)).astype("<u4")).view(np.int32) for s in sets], pa.int32()),
                        _lists([b if len(s) else none for b, s in zip(bands, sets, strict=True)], pa.int64()),
                    ],
                    ["row", "doc_id", "copy", "fp", "key", "n", "shingles", "bands"],
                )
                row += len(sets)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(F.col(text_col)).alias("copy"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, SIGNATURES)


def _wide(some: DataFrame) -> DataFrame:
    """(row, wide): the wide fingerprints of some rows of signatures()."""

    def run(batches):
        for batch in batches:
            found = [wide_fingerprint(_mix(np.array(s, dtype=np.int64).astype(np.uint64))) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(found, pa.int64())], ["row", "wide"])

    return some.select("row", "shingles").mapInArrow(run, "row long, wide array<long>")


def _candidates(found: DataFrame) -> DataFrame:
    """Of pairs (a, na, fa, b, nb, fb, and with root or wide fingerprint also these) of nodes the distinct ones, a < b, of different roots, whose sizes allow ALIKE and whose fingerprints pass the pigeonring filter."""
    kept = (F.col("a") != F.col("b")) & (F.least("na", "nb") >= ALIKE * F.greatest("na", "nb") - 1e-9)
    kept = kept & pigeonring(F.col("fa"), F.col("fb"), DISTANCE, SEGMENTS) & (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= DISTANCE)
    if "ra" in found.columns:
        kept = kept & (F.col("ra") != F.col("rb"))
    if "wa" in found.columns:  # each pair once: in its first band, and not from both sides
        kept = kept & (~F.col("ob") | (F.col("a") < F.col("b"))) & (F.col("band") == F.array_min(F.array_intersect("ba", "bb")))
        differ = F.lit(0)
        for w in range(WIDE):
            differ = differ + F.bit_count(F.col("wa")[w].bitwiseXOR(F.col("wb")[w]))
        kept = kept & ((F.least("na", "nb") < LEAST) | (differ <= WIDE_DISTANCE))
    return found.filter(kept).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def alike(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both >= ALIKE * (F.size(a) + F.size(b) - both) - F.lit(1e-9)


def _verified(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs (src, dst) of rows whose sets are ALIKE; only the sets of rows that stand in a pair are moved."""
    rows = materialize(pairs.select(F.col("src").alias("row")).unionByName(pairs.select(F.col("dst").alias("row"))).distinct(), "near-paired")
    sets = materialize(signed.select("row", "shingles").join(broadcast_small(rows, 32), "row"), "near-sets")
    left, right = (sets.select(F.col("row").alias(x), F.col("shingles").alias(f"s_{x}")) for x in ("src", "dst"))
    found = materialize(pairs.join(left, "src").join(right, "dst").filter(alike(F.col("s_src"), F.col("s_dst"))).select("src", "dst"), "near-found")
    discard(rows, sets)
    return found


def links(signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst) between nodes, known by their row, that give the same components as all near copies."""
    shaped = signed.select("row", "fp", "n", "bands").join(nodes.select("row"), "row")
    keyed = materialize(shaped.select("row", "n", "fp", F.explode("bands").alias("band")), "near-bands")
    own = F.struct("row", "n", "fp")
    picks = [F.min_by(own, F.xxhash64("row", F.lit(j))).alias(f"p{j}") for j in range(PIVOTS)]
    bins = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("members"), *picks).filter("members > 1")
    bins = materialize(bins.select("band", "members", F.array(*[f"p{j}" for j in range(PIVOTS)]).alias("pivots"), F.col("members").alias("size")), "near-bins")
    binned = materialize(lookup_join(keyed, bins, ["band"], "members"), "near-binned")
    discard(keyed, bins)

    def side(frame: DataFrame, x: str) -> DataFrame:
        names = {"row": x, "n": f"n{x}", "fp": f"f{x}", "root": f"r{x}", "wide": f"w{x}", "bands": f"b{x}", "out": f"o{x}"}
        return frame.select("band", *[F.col(c).alias(names[c]) for c in frame.columns if c in names])

    def paired(left: DataFrame, right: DataFrame) -> DataFrame:
        return side(left, "a").join(side(right, "b"), "band")

    cold, hot = binned.filter(F.col("size") <= BIN), binned.filter(F.col("size") > BIN)
    if not hot.limit(1).count():
        pairs = materialize(_candidates(paired(cold, cold).filter("a < b")), "near-pairs")
        return _verified(pairs, signed)

    largest = hot.groupBy("row").agg(F.max_by(F.struct("n", "fp", "pivots"), F.struct("size", "band")).alias("m"))
    pivoted = largest.select(F.col("row").alias("a"), F.col("m.n").alias("na"), F.col("m.fp").alias("fa"), F.explode("m.pivots").alias("p"))
    bands = materialize(hot.groupBy("row").agg(F.collect_set("band").alias("bands")), "near-hot-rows")  # at most BANDS each
    wide = materialize(bands.join(_wide(signed.join(broadcast_small(bands.select("row"), 32), "row")), "row"), "near-wide")
    found, tried = None, None
    for more in MORE_PIVOTS:
        pairs = _candidates(pivoted.select("a", "na", "fa", F.col("p.row").alias("b"), F.col("p.n").alias("nb"), F.col("p.fp").alias("fb")))
        pairs = materialize(pairs if tried is None else pairs.join(tried, ["src", "dst"], "left_anti"), "near-pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        linked = _verified(pairs, signed)
        found = linked if found is None else found.unionByName(linked)
        roots = materialize(connected_components(found).withColumnRenamed("node", "row"), "near-roots")
        rooted = materialize(binned.select("band", "row", "n", "fp", "size").join(roots, "row", "left").withColumn("root", F.coalesce("root", "row")), "near-rooted")
        hot = rooted.filter(F.col("size") > BIN)
        held = hot.groupBy("band", "root").agg(F.count(F.lit(1)).alias("held"), *[F.min_by(own, F.xxhash64("row", F.lit(j))).alias(f"p{j}") for j in range(more)])
        best = F.struct("held", "root")
        shares = held.groupBy("band").agg(F.max_by("root", best).alias("largest"), F.sum("held").alias("members"), *([F.max_by(F.array(*[f"p{j}" for j in range(more)]), best).alias("pivots")] if more else []))
        hot = lookup_join(hot, materialize(shares, "near-largest"), ["band"], "members").withColumn("out", F.col("root") != F.col("largest"))
        if more:
            pivoted = hot.filter("out").select(F.col("row").alias("a"), F.col("n").alias("na"), F.col("fp").alias("fa"), F.explode("pivots").alias("p"))
    cold = rooted.filter(F.col("size") <= BIN)
    hot = materialize(hot.drop("largest", "pivots").join(wide, "row"), "near-hot")
    rest = _candidates(paired(cold, cold).filter("a < b")).unionByName(_candidates(paired(hot.filter("out"), hot))).distinct().join(tried, ["src", "dst"], "left_anti")
    return found.unionByName(_verified(materialize(rest, "near-rest"), signed))


def one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every group of near copies, linked to one another, one row with all columns of docs: that of the smallest doc_id (a null comes last; ties: the least hash of the text)."""
    signed = materialize(signatures(docs, id_col, text_col), "near-signatures")
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy")
    nodes = materialize(signed.groupBy("key").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n"), F.min(who).alias("least")), "near-nodes")
    named = named_by_root(nodes, connected_components(links(signed, nodes)), "row")
    kept = materialize(named.groupBy("component_id").agg(F.count(F.lit(1)).alias("held")).select("component_id.doc_id", "component_id.copy"), "near-kept")
    rows = signed.groupBy("doc_id", "copy").agg(F.count(F.lit(1)).alias("held"))
    mine = [rows["doc_id"].eqNullSafe(kept["doc_id"]), rows["copy"] == kept["copy"]]
    removed = materialize(rows.join(kept, mine, "left_anti").select("doc_id", "copy"), "near-removed")
    repeated = materialize(rows.filter("held > 1").join(kept, mine, "left_semi").select("doc_id", "copy"), "near-repeated")
    left = without(docs, removed, id_col, text_col)
    if repeated.limit(1).count():  # one of the rows that repeat a kept row's doc_id and text
        some = matching(left, repeated, "left_semi", id_col, text_col).withColumn("_kelpie_copy", text_hash(F.col(text_col)))
        left = without(left, repeated, id_col, text_col).unionByName(some.dropDuplicates([id_col, "_kelpie_copy"]).drop("_kelpie_copy"))
    discard(signed, nodes)
    return left
