"""Benchmark decontamination by spaced-seed hashing, all in DataFrame functions.

A mask compares four token positions and ignores others. Each position of a
document and of a benchmark item is hashed under every mask; equal hashes are
hits, each on a diagonal (document position less item position). Around the hits
of a diagonal the item is laid against the document: in the best window of WINDOW
tokens (the whole item, if shorter) at least SIMILARITY of the positions must hold
the same token. Substituted tokens so cost matches but hide nothing.

The masks find every such window, whatever is substituted: of at least SHORTEST
tokens with no more than a fifth substituted, either four neighbours are left,
or five of which an inner one is substituted. So a window that overlaps has a
hit inside it, and only the windows around hits are looked at.

Tokens are the runs of letters and digits of the lower-cased text. Every mask
compares a place and the next one; places of a document whose two tokens do not
follow each other in any item are dropped before the masks are hashed. Documents
are cut into blocks of BLOCK places, with the tokens around them that a window
can reach, so that rows stay small however long a text is.

Seeds and items are broadcast up to BROADCAST_BYTES (counted); beyond, the same
joins are left to the shuffle, and only rows that pass them carry tokens on.

Edge cases: null and empty texts on either side match nothing; items of fewer
than SHORTEST tokens, of which one substitution already leaves less than
SIMILARITY, are nobody's leak; repeated rows of documents or items are each
judged and give one row for each pair of ids; null ids are kept; very long texts
are compared whole; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.llm.common import BROADCAST_BYTES, broadcast_small, materialize, text_hash, without

#: The compared places, counted from the first of the neighbouring two that all masks compare.
MASKS = ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (-2, 0, 1, 2))
WINDOW, SIMILARITY, SHORTEST, BLOCK = 20, 0.8, 5, 64
#: Tokens before and after a place that a window with a hit there can reach.
BEFORE, AFTER = WINDOW, WINDOW + 1


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>"))


def _seeds(h: str, at: str) -> Column:
    """The hash of the tokens under each mask at place `at` of the array h (0-based); the mask's number is hashed too. Null where a mask does not fit."""
    found = []
    for k, mask in enumerate(MASKS):
        picked = [f"get({h}, {at} + {j})" for j in mask]
        found.append(f"if({' or '.join(f'{p} is null' for p in picked)}, null, xxhash64({k}, {', '.join(picked)}))")
    return F.expr(f"array({', '.join(found)})")


def _hashed(df: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """(id, copy, h): copy tells rows with the same id but other texts apart; h are the hashes of the tokens."""
    return df.select(F.col(id_col).cast("long").alias(name), text_hash(F.col(text_col)).alias("copy"), F.transform(tokens(F.col(text_col)), lambda w: F.xxhash64(w)).alias("h"))


def _blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, copy, first, start, h): the places first to first + BLOCK - 1 of a document, with the tokens around them; h begins at place `start`."""
    cut = docs.select("doc_id", "copy", "h", F.explode(F.expr(f"sequence(0, size(h) - 1, {BLOCK})")).alias("first"))
    cut = cut.withColumn("start", F.greatest(F.lit(0), F.col("first") - BEFORE))
    return cut.select("doc_id", "copy", "first", "start", F.expr(f"slice(h, start + 1, first - start + {BLOCK + AFTER})").alias("h"))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, copy, item_id, similarity) of every text and item that overlap; copy is text_hash()."""
    bench = _hashed(items, item_id_col, item_text_col, "item_id").filter(F.size("h") >= SHORTEST).select("item_id", F.col("copy").alias("item_copy"), F.col("h").alias("item_h")).dropDuplicates(["item_id", "item_copy"])
    bench = materialize(bench, "leaks-items")
    placed = bench.select("item_id", "item_copy", "item_h", F.explode(F.expr("sequence(0, size(item_h) - 2)")).alias("j"))
    starts = materialize(placed.select(F.expr("xxhash64(get(item_h, j), get(item_h, j + 1))").alias("pair")).distinct(), "leaks-pairs")
    seeds = materialize(placed.select("item_id", "item_copy", "j", F.explode(_seeds("item_h", "j")).alias("seed")).filter("seed is not null"), "leaks-seeds")

    hashed = _hashed(docs, id_col, text_col, "doc_id").filter(F.size("h") >= 2)
    at = _blocks(hashed).select("doc_id", "copy", "start", "h", F.explode(F.expr(f"sequence(first - start, least(first - start + {BLOCK}, size(h) - 1) - 1)")).alias("i"))
    at = at.withColumn("pair", F.expr("xxhash64(get(h, i), get(h, i + 1))")).join(broadcast_small(starts, 32), "pair", "left_semi")
    marked = at.select("doc_id", "copy", "start", "h", "i", F.explode(_seeds("h", "i")).alias("seed")).filter("seed is not null")
    hits = marked.join(broadcast_small(seeds, 80), "seed").select("doc_id", "copy", "item_id", "item_copy", (F.col("start") + F.col("i") - F.col("j")).alias("diagonal"), "start", "h")
    hits = hits.dropDuplicates(["doc_id", "copy", "item_id", "item_copy", "diagonal", "start"])

    # On each diagonal of a block with a hit the item is laid beside the block; what lies outside the document is no match.
    whole = bench.select(F.col("item_id").alias("whole_id"), F.col("item_copy").alias("whole_copy"), "item_h")
    size = bench.agg(F.sum(F.size("item_h") * 8 + 64)).first()[0] or 0
    whole = F.broadcast(whole) if size <= BROADCAST_BYTES else whole
    laid = hits.join(whole, F.col("item_id").eqNullSafe(F.col("whole_id")) & (F.col("item_copy") == F.col("whole_copy")))
    laid = laid.withColumn("at", F.expr("greatest(start - diagonal, 0)")).withColumn("skip", F.expr("greatest(diagonal - start, 0)"))
    same = F.expr("zip_with(slice(h, skip + 1, size(item_h)), slice(item_h, at + 1, greatest(size(h) - skip, 0)), (a, b) -> if(a = b, 1, 0))")
    laid = laid.select("doc_id", "copy", "item_id", F.expr(f"least({WINDOW}, size(item_h))").alias("width"), same.alias("same"))
    best = F.expr("array_max(transform(sequence(0, greatest(size(same) - width, 0)), k -> aggregate(slice(same, k + 1, width), 0, (s, x) -> s + x)))")
    judged = laid.select("doc_id", "copy", "item_id", (best / F.col("width")).alias("similarity")).filter(F.col("similarity") >= SIMILARITY)
    return judged.groupBy("doc_id", "copy", "item_id").agg(F.max("similarity").alias("similarity"))


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity) of every document and item that overlap: the best window's share of equal tokens, SIMILARITY at least."""
    return leaks(docs, items, id_col, text_col, item_id_col, item_text_col).groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text overlaps no item. Rows with one doc_id, or none, are judged each by their own text."""
    leaked = materialize(leaks(docs, items, id_col, text_col).select("doc_id", "copy").distinct(), "leaked")
    return without(docs, leaked, id_col, text_col)


def oracle() -> str:
    """DuckDB SQL for overlaps() of the tables documents and benchmark, without masks: every diagonal on which two neighbouring tokens agree is laid out in full."""
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
b AS (SELECT * FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark) WHERE len(w) >= {SHORTEST}),
dp AS (SELECT doc_id, w[p] AS u, w[p + 1] AS v, p FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS p FROM d)),
bp AS (SELECT item_id, w[p] AS u, w[p + 1] AS v, p FROM (SELECT item_id, w, unnest(range(1, len(w))) AS p FROM b)),
hit AS (SELECT DISTINCT doc_id, item_id, dp.p - bp.p AS diagonal FROM dp JOIN bp USING (u, v)),
laid AS (
  SELECT h.doc_id, h.item_id, h.diagonal, len(b.w) AS n, d.w AS dw, b.w AS bw, least({WINDOW}, len(b.w)) AS width
  FROM hit h JOIN d ON d.doc_id = h.doc_id JOIN b ON b.item_id = h.item_id),
cell AS (
  SELECT doc_id, item_id, diagonal, width, n, j,
         CASE WHEN j + diagonal BETWEEN 1 AND len(dw) AND dw[j + diagonal] = bw[j] THEN 1 ELSE 0 END AS same
  FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM laid)),
run AS (
  SELECT doc_id, item_id, width, j, n, sum(same) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY j) AS upto, diagonal FROM cell),
best AS (
  SELECT a.doc_id, a.item_id, (a.upto - coalesce(z.upto, 0)) / a.width::DOUBLE AS similarity
  FROM run a LEFT JOIN run z ON z.doc_id = a.doc_id AND z.item_id = a.item_id AND z.diagonal = a.diagonal AND z.j = a.j - a.width
  WHERE a.j >= a.width)
SELECT doc_id, item_id, max(similarity) AS similarity FROM best WHERE similarity >= {SIMILARITY} GROUP BY doc_id, item_id
"""
