"""An n-gram language model by deleted interpolation (bigrams unless told otherwise).

    P(w | v) = l2[b] * c(v, w) / c(v) + l1[b] * c(w) / N + l0[b] / (V + 1),   b = bucket of c(v)

The counts are those of all training documents. The weights of each bucket of
context frequency (unseen, then powers of two) come from expectation-
maximisation: part of the training documents is deleted from the counts, and the
weights maximise the likelihood of its tokens under the estimates from the rest.

Everything is counted over the whole corpus. Documents are packed into chunks of
a few megabytes (word numbers and the hashes of the chunk's words), written
once. A chunk's distinct n-grams are sorted 64-bit keys with counts (already
summed); it sends them in 2**BITS messages, by the keys' first bits, to the node
of its group of 2**BITS chunks. With more than one group, a node's sums are sent
on in the same way, by the next bits, to groups of groups, until one is left:
that node has the totals, and they return by the same way, in the order of the
keys of each message. So every level sends as many messages as there are chunks
times 2**BITS, no task holds more than the messages of one node, and a very
frequent word costs one key for each chunk. The driver gets sums, and the cells of
a histogram (at most 64 buckets x 82 for each estimate, whatever the corpus), on
which it runs the maximisation.

Tokens: the words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, then one end, which
is also the context of a first word.

Edge cases: a null or empty text is its end alone; a null doc_id counts as the
empty text where its fold is drawn; repeated rows are counted and scored each;
an empty table or one without training documents gives scores from the uniform
part; other columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpie.llm.bpe import slices
from kelpie.llm.common import broadcast_small, discard, materialize, partitions

#: The order of the model; bits of a key that a level of sums deals by; deleted and held-out remainders of the fold; iterations of EM.
ORDER, BITS, FOLDS, HELD_OUT, DELETED, ITERATIONS = 2, 8, 5, 1, 0, 200
CELL, CELLS = 0.25, 80
#: Text of a chunk; tokens scored at once.
CHUNK_BYTES, TOKENS_AT_ONCE = 8 << 20, 1 << 17
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * _M2
    x = (x ^ x >> np.uint64(29)) * _M1
    return x ^ x >> np.uint64(32)


def _pack(x: np.ndarray) -> bytes:
    """Unsigned 64-bit integers by byte planes, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def fold(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents as chunks: (chunk, train, kept, doc_ids, sizes, words, numbers), with their training tokens and those that are not deleted."""

    def run(batches):
        part_id, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, most=CHUNK_BYTES):
                vocabulary: dict[bytes, int] = {b"": 0}  # the end
                numbers, sizes = [], []
                put = vocabulary.setdefault
                for text in part.column(1).to_pylist():
                    words = (text or b"").lower().split()
                    numbers += [put(w, len(vocabulary)) for w in words]
                    numbers.append(0)
                    sizes.append(len(words) + 1)
                hashes = np.fromiter(map(xxhash.xxh64_intdigest, vocabulary), dtype=np.uint64, count=len(vocabulary))
                folds = [fold(d) for d in part.column(0).to_pylist()]
                train = sum(n for n, f in zip(sizes, folds, strict=True) if f != HELD_OUT)
                kept = train - sum(n for n, f in zip(sizes, folds, strict=True) if f == DELETED)
                packed = zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(np.array(numbers, dtype="<u4").view(np.uint8).reshape(-1, 4).T).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part_id << 32 | seq], pa.int64()), pa.array([train], pa.int64()), pa.array([kept], pa.int64()), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int32())), pa.array([hashes.tobytes()], pa.binary()), pa.array([packed], pa.binary())],
                    ["chunk", "train", "kept", "doc_ids", "sizes", "words", "numbers"],
                )
                seq += 1

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "chunk long, train long, kept long, doc_ids array<long>, sizes array<int>, words binary, numbers binary")


class Chunk:
    """A chunk's tokens and its distinct n-grams of each order; words are the chunk's word hashes, needed for keys only."""

    def __init__(self, doc_ids: list, sizes: list, numbers: bytes, words: bytes | None = None, order: int = ORDER):
        self.doc_ids, self.sizes = doc_ids, np.array(sizes, dtype=np.int64)
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(numbers), dtype=np.uint8).reshape(4, -1)
        word = np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)
        n_words = int(word.max()) + 1 if words is None else len(words) // 8
        first = np.cumsum(self.sizes) - self.sizes
        self.gram, self.context, self.distinct = [word], [], [n_words]  # of each order: the token's n-gram, that of its context (-1: the document's start)
        hashes = None if words is None else np.frombuffer(words, dtype=np.uint64)
        keys = [] if hashes is None else [_mix(hashes)]
        for k in range(2, order + 1):
            context = np.concatenate((self.gram[-1][:1], self.gram[-1][:-1]))
            context[first] = 0 if k == 2 else -1  # for bigrams the end, whose number is 0
            distinct, number = np.unique((context + 1) * n_words + word, return_inverse=True)
            if keys:
                before = np.concatenate((np.array([k], dtype=np.uint64), keys[-1]))  # of the start
                keys.append(_mix(before[distinct // n_words] * _M1 + hashes[distinct % n_words]))
            self.gram.append(number)
            self.context.append(context)
            self.distinct.append(len(distinct))
        if keys:  # a word's key is odd, others are even
            every = np.concatenate([keys[0] | np.uint64(1), *(x & ~np.uint64(1) for x in keys[1:])])
            self.order = np.argsort(every)
            self.keys = every[self.order]
        self.folds = np.array([fold(d) for d in doc_ids], dtype=np.int64)
        self.token_fold = np.repeat(self.folds, self.sizes)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of training tokens, and of those that are deleted, in the order of the keys."""
        out = []
        for some in (self.token_fold != HELD_OUT, self.token_fold == DELETED):
            every = np.concatenate([np.bincount(g[some], minlength=n) for g, n in zip(self.gram, self.distinct, strict=True)])
            out.append(every[self.order].astype(np.uint64))
        return out[0], out[1]

    def unsorted(self, sent: np.ndarray) -> np.ndarray:
        """Values in the order of the keys, in that of the n-grams."""
        values = np.empty(len(self.keys), dtype=np.uint64)
        values[self.order] = sent
        return values

    def estimates(self, totals: np.ndarray, tokens: int, some: slice | np.ndarray = slice(None)) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Of some tokens the count of the longest context, the estimates from the highest order down, and the counts of their words; totals in the order of the n-grams."""
        by_order = np.split(totals, np.cumsum(self.distinct)[:-1])
        starts = by_order[0][0]  # as many documents as ends
        found, context = [by_order[0][self.gram[0][some]] / max(1, tokens)], np.full(len(self.gram[0][some]), tokens, dtype=np.float64)
        for k in range(1, len(by_order)):
            at = self.context[k - 1][some]
            context = np.where(at < 0, starts, by_order[k - 1][at]).astype(np.float64)
            found.append(ratio(by_order[k][self.gram[k][some]], context))
        return context, found[::-1], by_order[0][self.gram[0][some]].astype(np.float64)


def _rows(table: pa.Table | pa.RecordBatch, *names: str):
    return zip(*(table.column(n).to_pylist() for n in names), strict=True)


MESSAGE = "grp long, node long, source long, keys binary, totals binary, deleted binary"
ANSWER = "source long, node long, totals binary, deleted binary"


def _messages(bits: int, source: int, node: int, depth: int, keys: np.ndarray, totals: np.ndarray, deleted: np.ndarray) -> list[tuple]:
    """Sorted keys with sums, dealt by the `bits` bits that follow those of the node."""
    place = (keys >> np.uint64(64 - bits * (depth + 1))).astype(np.int64)
    base = node << bits
    cut = np.searchsorted(place, np.arange(base, base + (1 << bits) + 1))
    out = []
    for d in range(1 << bits):
        i, j = cut[d], cut[d + 1]
        if i < j:
            steps = np.concatenate((keys[i : i + 1], keys[i + 1 : j] - keys[i : j - 1]))
            out.append((source >> bits, base + d, source, _pack(steps), _pack(totals[i:j]), _pack(deleted[i:j])))
    return out


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


def _merged(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys of some messages (source, keys, ...), where each message's keys are among them, and where each message ends."""
    keys = [np.cumsum(_unpack(r[1]), dtype=np.uint64) for r in rows]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, at, np.cumsum([0, *map(len, keys)])


def _sums(rows: list[tuple], at: np.ndarray, n: int) -> list[np.ndarray]:
    return [np.bincount(at, weights=np.concatenate([_unpack(r[k]) for r in rows]).astype(np.float64), minlength=n).astype(np.uint64) for k in (2, 3)]


def totals_of(sent: DataFrame, groups: int, bits: int, depth: int = 0) -> DataFrame:
    """Of each message the totals of its keys over all messages: (source, node, totals, deleted). Beside them, with source -1, the numbers of distinct words in all and in the part that is not deleted."""
    parts = partitions(sent.sparkSession)

    def add(table: pa.Table) -> pa.Table:
        rows = sorted(_rows(table, "source", "keys", "totals", "deleted"))
        distinct, at, cut = _merged(rows)
        every, deleted = _sums(rows, at, len(distinct))
        words = (distinct & np.uint64(1)).astype(bool)
        node = table.column("node")[0].as_py()
        out = [(r[0], node, _pack(every[at[i:j]]), _pack(deleted[at[i:j]])) for r, i, j in zip(rows, cut, cut[1:], strict=False)]
        out.append((-1, node, _pack(np.array([(words & (every > 0)).sum(), (words & (every > deleted)).sum()], dtype=np.uint64)), b""))
        return _table(out, ANSWER)

    def forward(table: pa.Table) -> pa.Table:
        rows = sorted(_rows(table, "source", "keys", "totals", "deleted"))
        distinct, at, _ = _merged(rows)
        return _table(_messages(bits, table.column("grp")[0].as_py(), table.column("node")[0].as_py(), depth + 1, distinct, *_sums(rows, at, len(distinct))), MESSAGE)

    def back(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _table([], ANSWER)
        rows = sorted(_rows(left, "source", "keys"))
        _, at, cut = _merged(rows)
        every, deleted = _received(right)
        node = left.column("node")[0].as_py()
        return _table([(r[0], node, _pack(every[at[i:j]]), _pack(deleted[at[i:j]])) for r, i, j in zip(rows, cut, cut[1:], strict=False)], ANSWER)

    if groups == 1:
        return sent.repartition(parts, "node").groupBy("node").applyInArrow(add, ANSWER)
    sent = materialize(sent, "lm-messages")
    on = materialize(sent.groupBy("grp", "node").applyInArrow(forward, MESSAGE), "lm-sums")
    answers = materialize(totals_of(on, -(-groups >> bits), bits, depth + 1), "lm-answers")
    up = answers.filter("source >= 0").select(F.col("source").alias("grp"), F.shiftright("node", bits).alias("parent"), "node", "totals", "deleted")
    returned = sent.groupBy("grp", "node").cogroup(up.groupBy("grp", "parent")).applyInArrow(back, ANSWER)
    return returned.unionByName(answers.filter("source < 0"))


def _received(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted(_rows(table, "node", "totals", "deleted"))
    return tuple(np.concatenate([_unpack(r[k]) for r in rows]) for k in (1, 2))


def numbered(packed: DataFrame) -> DataFrame:
    """Adds `source`, which numbers the chunks without gaps; the window runs over one line for each task that packed them."""
    lines = packed.groupBy(F.shiftright("chunk", 32).alias("task")).agg(F.count(F.lit(1)).alias("held"))
    base = F.sum("held").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    lines = materialize(lines.select("task", F.coalesce(base, F.lit(0)).alias("base")), "lm-tasks")
    return packed.join(broadcast_small(lines, 48), F.shiftright("chunk", 32) == F.col("task")).withColumn("source", F.col("base") + F.col("chunk").bitwiseAND(F.lit((1 << 32) - 1)))


def counted(packed: DataFrame, chunks_in: int, order: int, bits: int) -> tuple[DataFrame, int, int]:
    """The chunks with the totals of their n-grams, all and without the deleted, and the numbers of distinct words in either: (doc_ids, sizes, numbers, totals, remaining)."""
    def emit(batches):
        for batch in batches:
            for source, *row, words in _rows(batch, "source", "doc_ids", "sizes", "numbers", "words"):
                c = Chunk(*row, words, order)
                yield from _table(_messages(bits, source, 0, 0, c.keys, *c.counts()), MESSAGE).to_batches()

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        doc_ids, sizes, numbers, words = next(_rows(left, "doc_ids", "sizes", "numbers", "words"))
        c = Chunk(doc_ids, sizes, numbers, words, order)
        every, deleted = _received(right)
        every, deleted = c.unsorted(every), c.unsorted(deleted)
        return left.select(["doc_ids", "sizes", "numbers"]).append_column("totals", pa.array([_pack(every)], pa.binary())).append_column("remaining", pa.array([_pack(every - deleted)], pa.binary()))

    answers = materialize(totals_of(packed.mapInArrow(emit, MESSAGE), -(-chunks_in >> bits), bits), "lm-totals")
    about = [_unpack(r.totals) for r in answers.filter("source = -1").select("totals").toLocalIterator()]
    distinct, remaining = (int(x) for x in np.sum(about, axis=0)) if about else (0, 0)
    joined = packed.groupBy("source").cogroup(answers.filter("source >= 0").groupBy("source")).applyInArrow(join, "doc_ids array<long>, sizes array<int>, numbers binary, totals binary, remaining binary")
    joined = materialize(joined, "lm-joined")
    discard(answers)
    return joined, distinct, remaining


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 and the power of two at or below its count."""
    return np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))), 0).astype(np.int64)


def ratio(a: np.ndarray, b: np.ndarray | float) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=np.broadcast_to(np.asarray(b) > 0, a.shape))


@dataclass(frozen=True)
class Model:
    tokens: int
    distinct: int
    #: By bucket the weights of the estimates from the highest order down, and of the uniform one.
    weights: tuple[tuple[float, ...], ...]


def maximise(cells: list[tuple], uniform: float, order: int = ORDER) -> tuple[tuple[float, ...], ...]:
    """The weights of each bucket from (bucket, tokens, estimates from the highest order down); a bucket without tokens takes those of the one below."""
    out, previous = [], (*[0.0] * (order - 1), 0.9, 0.1)
    by_bucket: dict[int, list[tuple]] = {}
    for c in cells:
        by_bucket.setdefault(c[0], []).append(c[1:])
    for b in range(65):
        if b in by_bucket:
            n, *own = np.array(by_bucket[b]).T
            p = np.vstack((*own, np.full(len(n), uniform)))
            w = np.full(order + 1, 1 / (order + 1))
            for _ in range(ITERATIONS):
                mixed = w[:, None] * p
                new = (mixed / mixed.sum(axis=0) * n).sum(axis=1) / n.sum()
                done = np.abs(new - w).max() < 1e-9
                w = new
                if done:
                    break
            w = np.maximum(w, [*[0] * order, 1e-6])
            previous = tuple((w / w.sum()).tolist())
        out.append(previous)
    return tuple(out)


def _cells(joined: DataFrame, kept: int, order: int) -> list[tuple]:
    """The deleted tokens by context bucket and by the estimates from the rest, which are binned by their logarithm: (bucket, tokens, the geometric means of the estimates)."""

    def run(batches):
        for batch in batches:
            for doc_ids, sizes, numbers, remaining in _rows(batch, "doc_ids", "sizes", "numbers", "remaining"):
                c = Chunk(doc_ids, sizes, numbers, order=order)
                context, found, _ = c.estimates(_unpack(remaining), kept, c.token_fold == DELETED)
                logs = [np.log(np.where(p > 0, p, 1)) for p in found]
                code = bucket(context)
                for p, x in zip(found, logs, strict=True):
                    code = code * (CELLS + 2) + np.where(p > 0, np.minimum(np.floor(-x / CELL), CELLS).astype(np.int64), CELLS + 1)
                cell, at, count = np.unique(code, return_inverse=True, return_counts=True)
                sums = [np.bincount(at, weights=x, minlength=len(cell)).astype(np.float64) for x in logs]  # of nothing bincount makes integers
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(count.astype(np.int64)), *map(pa.array, sums)], ["cell", "n", *names])

    names = [f"log{k}" for k in range(order)]
    found = joined.mapInArrow(run, ", ".join(["cell long", "n long", *(f"{x} double" for x in names)]))
    rows = []
    for cell, n, *sums in sorted(found.groupBy("cell").agg(F.sum("n"), *map(F.sum, names)).collect()):
        means = []
        for x in reversed(sums):
            cell, place = divmod(cell, CELLS + 2)
            means.append(0.0 if place > CELLS else float(np.exp(x / n)))
        rows.append((cell, float(n), *reversed(means)))
    return rows


def score(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text."""
    packed = materialize(chunks(docs, id_col, text_col), "lm-chunks")
    tokens, kept, chunks_in = (x or 0 for x in packed.agg(F.sum("train"), F.sum("kept"), F.count(F.lit(1))).first())
    joined, distinct, remaining = counted(numbered(packed), max(1, chunks_in), order, bits)
    discard(packed)
    model = Model(tokens, distinct, maximise(_cells(joined, kept, order), 1 / (remaining + 1), order))
    weights = np.array(model.weights)

    def final(batches):
        for batch in batches:
            for doc_ids, sizes, numbers, totals in _rows(batch, "doc_ids", "sizes", "numbers", "totals"):
                c = Chunk(doc_ids, sizes, numbers, order=order)
                ends, every = np.cumsum(c.sizes), _unpack(totals)
                first = 0
                while first < len(ends):  # some documents at once, so that their tokens' estimates stay small
                    begin = int(ends[first] - c.sizes[first])
                    last = max(first + 1, int(np.searchsorted(ends, begin + TOKENS_AT_ONCE, side="right")))
                    context, found, own = c.estimates(every, model.tokens, slice(begin, int(ends[last - 1])))
                    w = weights[bucket(context)]
                    p = sum(w[:, k] * x for k, x in enumerate(found)) + w[:, order] / (model.distinct + 1)
                    base = np.log10((own + 0.5) / (model.tokens + 0.5 * (model.distinct + 1)))
                    starts = ends[first:last] - c.sizes[first:last] - begin
                    sums = [np.add.reduceat(x, starts) for x in ((own > 0).astype(np.int64), base, np.log10(p))]
                    columns = [pa.array(c.doc_ids[first:last], pa.int64()), c.folds[first:last] == HELD_OUT, c.sizes[first:last], sums[0], np.full(len(starts), model.tokens, dtype=np.int64), *sums[1:]]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
                    first = last

    return joined.select("doc_ids", "sizes", "numbers", "totals").mapInArrow(final, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
