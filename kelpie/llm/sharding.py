"""Sharding by Karmarkar-Karp differencing.

Groups (rows with equal texts) are indivisible. Every group starts as a partial
partition with its size in one of `shards` sets. Again and again the two partial
partitions of largest spread are combined, the largest sets of one with the
smallest of the other, until one is left.

Beyond GROUPS_EACH groups the differencing runs in levels, so that no task holds
all groups: the groups are dealt by hash to cells, and each cell is differenced to
`shards` bundles. While there are more than CELLS cells, up to GROUPS_EACH /
`shards` of them at once are differenced on to one, level by level. In the end
the CELLS * `shards` bundles are differenced one by one in one task, so that small
ones make up for large ones; with them the groups of more than 1 / SINGLE of a
shard's share, at most SINGLE for each shard, that no cell has taken. Nothing
goes through the driver but counts.

Edge cases: a null text counts as no bytes and shares the group of empty texts;
repeated rows are kept in their group; an empty table gives no rows; a null
doc_id is kept; fewer groups than shards leave shards empty; a group larger than
a shard's share stays whole, and the other shards are as equal as can be; other
columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from kelpie.llm.common import broadcast_small, discard, materialize, partitions
from kelpie.llm.skew import lookup_join

#: Groups in a task and rows in a cell of slots, roughly; bytes of overhead of a row.
GROUPS_EACH, ROWS_EACH, ROW_BYTES = 50_000, 20_000, 16
#: Cells of the last level; groups above 1 / SINGLE of a shard's share, at most SINGLE for each shard, stand alone.
CELLS, SINGLE = 1000, 25


def difference(partials: list[list[tuple[int, int]]], ways: int) -> list[list[int]]:
    """Karmarkar-Karp over partial partitions, each a list of (sum, set) with at most `ways` sets; returns, by final set, the original sets in it.

    A partial is kept as its non-empty sets, largest first; the others count as
    zero. Sets are numbered; a joined set gets a number of its own and remembers
    its two halves, so that combining costs `ways` steps whatever the sets hold.
    """
    halves: dict[int, tuple[int, int]] = {}
    fresh = 1 + max((s for p in partials for _, s in p), default=0)
    heap = []
    for order, p in enumerate(partials):
        sets = sorted(p, reverse=True)
        spread = (sets[0][0] if sets else 0) - (sets[-1][0] if len(sets) == ways else 0)
        heap.append((-spread, order, sets))
    heapq.heapify(heap)
    order = len(partials)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        # Place i from the top of a meets place ways - 1 - i from the top of b; most places may be empty.
        alone = max(len(a), ways - len(b))
        sets = a[: ways - len(b)] + b[: ways - alone]
        for i in range(ways - len(b), len(a)):
            (x, s), (y, t) = a[i], b[ways - 1 - i]
            halves[fresh] = (s, t)
            sets.append((x + y, fresh))
            fresh += 1
        sets.sort(reverse=True)
        spread = sets[0][0] - (sets[-1][0] if len(sets) == ways else 0)
        heapq.heappush(heap, (-spread, order, sets))
        order += 1
    out = []
    for _, s in heap[0][2] if heap else []:
        members, todo = [], [s]
        while todo:
            x = todo.pop()
            if x in halves:
                todo += halves[x]
            else:
                members.append(x)
        out.append(members)
    return out + [[] for _ in range(ways - len(out))]


def _differenced(frame: DataFrame, key: str, run, column: str) -> DataFrame:
    """frame with a new int column that `run` finds for all rows of a key together."""
    schema = T.StructType([*frame.schema.fields, T.StructField(column, T.IntegerType())])
    return frame.groupBy(key).applyInArrow(lambda table: run(table, column), schema)


def _bundles(placed: DataFrame, bytes_in, *by) -> DataFrame:
    return placed.groupBy(*by).agg(F.sum(bytes_in).alias("bytes"))


def assign_groups(groups: DataFrame, shards: int, most: int = GROUPS_EACH, last_cells: int = CELLS) -> DataFrame:
    """Adds `shard` to a frame of groups with the columns h, crc, size and n (rows); balances n * size."""
    weight = F.col("n") * F.col("size")
    number, total = groups.agg(F.count(F.lit(1)), F.sum(weight)).first()
    parts = max(1, math.ceil(number / most))
    if parts == 1:

        def plain(table: pa.Table, column: str) -> pa.Table:
            table = table.sort_by([("h", "ascending"), ("crc", "ascending"), ("size", "ascending")])
            weights = (table.column("n").to_numpy() * table.column("size").to_numpy()).tolist()
            found = np.empty(len(weights), dtype=np.int32)
            for shard, members in enumerate(difference([[(w, j)] for j, w in enumerate(weights)], shards)):
                found[members] = shard
            return table.append_column(column, pa.array(found))

        return _differenced(groups.withColumn("all", F.lit(0)), "all", plain, "shard").drop("all")  # at most `most` groups

    bound, cells = total / shards / SINGLE, max(last_cells, parts)
    alone = weight > bound
    dealt = groups.withColumn("cell", F.when(alone, -1 - F.pmod(F.col("h"), F.lit(parts))).otherwise(F.pmod(F.xxhash64("h", "crc", "size"), F.lit(cells)))).withColumn("part", F.pmod("cell", F.lit(parts)))

    def cell_by_cell(table: pa.Table, column: str) -> pa.Table:
        table = table.sort_by([("cell", "ascending"), ("h", "ascending"), ("crc", "ascending"), ("size", "ascending")])
        weights = (table.column("n").to_numpy() * table.column("size").to_numpy()).tolist()
        cell = table.column("cell").to_numpy()
        found = np.arange(len(weights), dtype=np.int32)  # for those that stand alone
        for some in np.split(np.arange(len(cell)), np.flatnonzero(np.diff(cell)) + 1):
            if cell[some[0]] >= 0:
                for i, members in enumerate(difference([[(weights[j], j)] for j in some.tolist()], shards)):
                    found[members] = i
        return table.append_column(column, pa.array(found))

    def partials(table: pa.Table, column: str) -> pa.Table:
        """Rows (cell, local, bytes): every cell is one partial partition."""
        table = table.sort_by([("cell", "ascending"), ("local", "ascending")])
        cell, size = table.column("cell").to_numpy(), table.column("bytes").to_pylist()
        some = np.split(np.arange(len(cell)), np.flatnonzero(np.diff(cell)) + 1)
        found = np.empty(len(cell), dtype=np.int32)
        for i, members in enumerate(difference([[(size[j], j) for j in one.tolist()] for one in some], shards)):
            found[members] = i
        return table.append_column(column, pa.array(found))

    def one_by_one(table: pa.Table, column: str) -> pa.Table:
        table = table.sort_by([("cell", "ascending"), ("local", "ascending")])
        found = np.empty(table.num_rows, dtype=np.int32)
        for shard, members in enumerate(difference([[(w, j)] for j, w in enumerate(table.column("bytes").to_pylist())], shards)):
            found[members] = shard
        return table.append_column(column, pa.array(found))

    placed = materialize(_differenced(dealt, "part", cell_by_cell, "local"), "shards-cells")
    bundles, levels = materialize(_bundles(placed, weight, "cell", "local"), "shards-bundles"), []
    while cells > last_cells:
        cells = max(last_cells, math.ceil(cells * shards / most))
        up = materialize(_differenced(bundles.filter("cell >= 0").withColumn("up", F.pmod("cell", F.lit(cells))), "up", partials, "up_local"), "shards-level")
        levels.append(up)
        bundles = materialize(_bundles(up.select(F.col("up").alias("cell"), F.col("up_local").alias("local"), "bytes"), F.col("bytes"), "cell", "local").unionByName(bundles.filter("cell < 0").select("cell", "local", "bytes")), "shards-bundles")
    final = materialize(_differenced(bundles.withColumn("all", F.lit(0)), "all", one_by_one, "shard").select("cell", "local", "shard"), "shards-final")  # last_cells * shards bundles and SINGLE * shards groups at most
    for up in reversed(levels):
        below = up.join(broadcast_small(final.withColumnRenamed("cell", "up").withColumnRenamed("local", "up_local"), 48), ["up", "up_local"]).select("cell", "local", "shard")
        final = materialize(below.unionByName(final.filter("cell < 0")), "shards-final")
    return placed.join(broadcast_small(final, 48), ["cell", "local"]).drop("cell", "local", "part")


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", most: int = GROUPS_EACH, last_cells: int = CELLS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row; equal texts share a shard.

    Texts are read once and never shuffled: a text is known by its 64-bit hash, its crc32 and
    its length. Very frequent texts are looked up by broadcast. Slots are
    numbered in cells of a shard, dealt by a hash of doc_id, so that a shard of
    any size is numbered by many tasks.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("h"))
    rows = materialize(rows, "shards-hashes")
    groups = materialize(rows.groupBy("h", "crc", "size").agg(F.count(F.lit(1)).alias("n")), "shards-groups")
    placed = materialize(assign_groups(groups, shards, most, last_cells), "shards-groups-placed")
    total = groups.agg(F.sum("n")).first()[0] or 0
    discard(groups)
    cells = max(1, math.ceil(total / shards / ROWS_EACH)) * 8
    dealt = materialize(lookup_join(rows, placed, ["h", "crc", "size"], "n").withColumn("cell", F.pmod(F.xxhash64("doc_id", "h"), F.lit(cells)).cast("int")), "shards-rows")
    counts = dealt.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("rows_in"))
    before = counts.withColumn("base", F.sum("rows_in").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "h")))
    return ranked.join(before.select("shard", "cell", F.coalesce("base", F.lit(0)).alias("base")), ["shard", "cell"]).select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
