"""Scans, filters and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kelpie.functions.numeric import dot, unit
from kelpie.operators import alignment, matrices
from kelpie.operators.scales import square_sum
from kelpie.plans.base import CELLS, VECS, query, r6
from kelpie.sources import manifests, vectors

SHIFTS = {0: 1, 1: 4, 2: 7, 3: 10}
H16 = matrices.hadamard(16)
HAD_SQL = "CASE WHEN bit_count((a.channel & k)::BIGINT) % 2 = 0 THEN 0.25 ELSE -0.25 END"


@query("scan_views", f"WITH {VECS} SELECT layer, head, token, vec[1] AS first_value, vec[16] AS last_value, len(vec)::INTEGER AS dim FROM vecs")
def scan_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.kv_vectors(spark, sf_dir).select("layer", "head", "token", F.col("vec")[0].alias("first_value"), F.col("vec")[15].alias("last_value"), F.size("vec").alias("dim"))


@query("resolve_sources", "SELECT vec_id % 4 AS layer, count(DISTINCT 'part-' || (vec_id % 4 % 2)) AS n_sources, min('part-' || (vec_id % 4 % 2)) AS source, count(*) AS n_rows FROM embeddings GROUP BY 1")
def resolve_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each layer must come from exactly one source; a layer with two fails."""
    rows = vectors.rows(spark, sf_dir).select("layer", F.concat(F.lit("part-"), (F.col("layer") % 2).cast("string")).alias("source"))
    found = rows.groupBy("layer").agg(F.countDistinct("source").alias("n_sources"), F.min("source").alias("source"), F.count(F.lit(1)).alias("n_rows"))
    return found.filter(F.when(F.col("n_sources") == 1, True).otherwise(F.raise_error(F.lit("a layer has two sources"))))


CHUNKS = """SELECT layer, segment, token, (rn // 4)::BIGINT AS kept FROM (
  SELECT vec_id % 4 AS layer, (vec_id // 4) // 32 AS segment, vec_id // 4 AS token,
         row_number() OVER (PARTITION BY vec_id % 4, (vec_id // 4) // 32 ORDER BY vec_id // 4) - 1 AS rn
  FROM embeddings WHERE label <> 9) WHERE rn % 4 = 0"""


@query("scan_chunks", CHUNKS)
def scan_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid tokens of each segment in order, every fourth; the filter and the two columns it needs reach the scan."""
    valid = vectors.rows(spark, sf_dir).filter("label <> 9").select("layer", F.col("block").alias("segment"), "token")
    ranked = valid.withColumn("rn", F.row_number().over(Window.partitionBy("layer", "segment").orderBy("token")) - 1)
    return ranked.filter("rn % 4 = 0").select("layer", "segment", "token", F.floor(F.col("rn") / 4).cast("long").alias("kept"))


SLABS = """WITH t AS (SELECT vec_id % 4 AS layer, vec_id // 4 AS token, (vec_id // 4) // 32 AS segment, (vec_id // 4) % 97 <> 5 AS ok FROM embeddings),
good AS (SELECT segment FROM (SELECT segment, layer, bool_and(ok) AS a, count(*) AS n FROM t GROUP BY 1, 2) GROUP BY 1 HAVING bool_and(a AND n = 32))
SELECT segment, token // 16 AS slab, layer, count(*) AS n_tokens, min(token) AS first_token FROM t WHERE segment IN (SELECT segment FROM good) GROUP BY 1, 2, 3"""


def _slabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.rows(spark, sf_dir).select("layer", "token", "block")
    kept = alignment.whole_segments(rows, F.col("block"), 32, F.col("token") % 97 != 5)
    return kept.groupBy("segment", F.floor(F.col("token") / 16).cast("long").alias("slab"), "layer").agg(F.count(F.lit(1)).alias("n_tokens"), F.min("token").alias("first_token"))


@query("scan_slabs", SLABS)
def scan_slabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slabs(spark, sf_dir)


@query("scan_slabs_even", f"WITH s AS (SELECT DISTINCT slab FROM ({SLABS})), r AS (SELECT slab, row_number() OVER (ORDER BY slab) - 1 AS i, count(*) OVER () AS n FROM s) SELECT slab FROM r WHERE n <= 3 OR i IN (SELECT round_even(k * (n - 1) / 2.0::DOUBLE, 0)::BIGINT FROM range(3) g(k))")
def scan_slabs_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.evenly_spaced(_slabs(spark, sf_dir).select("slab").distinct(), "slab", 3)


@query("limit_slabs", f"SELECT * FROM ({SLABS}) ORDER BY segment, slab, layer LIMIT 8")
def limit_slabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slabs(spark, sf_dir).orderBy("segment", "slab", "layer").limit(8)


@query("cache_objects", "SELECT (vec_id // 4) // 256 AS obj, count(*) AS n_rows, min(vec_id // 4) AS first_slot, max(vec_id // 4) AS last_slot, max(vec_id // 4) - min(vec_id // 4) + 1 < 256 AS is_tail FROM embeddings GROUP BY 1")
def cache_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = vectors.rows(spark, sf_dir).groupBy(F.floor(F.col("token") / 256).cast("long").alias("obj"))
    return slots.agg(F.count(F.lit(1)).alias("n_rows"), F.min("token").alias("first_slot"), F.max("token").alias("last_slot")).withColumn("is_tail", F.col("last_slot") - F.col("first_slot") + 1 < 256)


@query("read_book", "SELECT doc_id, sha256(text) AS context_sha256, length(text)::BIGINT AS n FROM documents WHERE sha256(text) = (SELECT sha256(text) FROM documents WHERE doc_id = 7)")
def read_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents whose text has a given SHA-256, as a context is found by its hash."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("context_sha256"), F.char_length("text").cast("long").alias("n"))
    wanted = docs.filter("doc_id = 7").select("context_sha256").limit(1)
    return docs.join(F.broadcast(wanted), "context_sha256").select("doc_id", "context_sha256", "n")


@query("filter_split", "SELECT CASE WHEN (vec_id // 4) % 4 = 0 THEN 'a' ELSE 'b' END AS split, label, count(*) AS n_rows FROM embeddings WHERE (vec_id // 4) % 4 <> 0 GROUP BY 1, 2")
def filter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when(F.col("token") % 4 == 0, "a").otherwise("b")
    return vectors.rows(spark, sf_dir).select(split.alias("split"), "label").filter("split = 'b'").groupBy("split", "label").agg(F.count(F.lit(1)).alias("n_rows"))


@query("resume_pending", "SELECT label, m.multiplier FROM (SELECT DISTINCT label FROM embeddings) CROSS JOIN (VALUES (0.5::DOUBLE), (0.75), (1.0), (1.25)) m(multiplier) WHERE NOT (label % 2 = 0 AND multiplier < 1.0)")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms (domain, multiplier) that no report holds yet."""
    domains = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label").distinct()
    arms = domains.crossJoin(F.broadcast(spark.createDataFrame([(0.5,), (0.75,), (1.0,), (1.25,)], "multiplier double")))
    reported = arms.filter("label % 2 = 0 and multiplier < 1.0")
    return arms.join(reported, ["label", "multiplier"], "left_anti")


@query("cache_kind", "SELECT name, CASE WHEN lower(trim(name)) IN ('key', 'k', 'keys') THEN 'key' WHEN lower(trim(name)) IN ('value', 'v', 'values') THEN 'value' END AS kind FROM (VALUES ('Key'), (' k '), ('KEYS'), ('value'), ('V'), (' Values'), ('query')) t(name)")
def cache_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(n,) for n in ("Key", " k ", "KEYS", "value", "V", " Values", "query")], "name string")
    return names.select("name", manifests.cache_kind(F.col("name")).alias("kind"))


@query("view_means", f"WITH {CELLS} SELECT layer, head, channel, round(avg(v), 9) AS mean_value FROM cells GROUP BY 1, 2, 3")
def view_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.kv_cells(spark, sf_dir).groupBy("layer", "head", "channel").agg(F.round(F.avg("v"), 9).alias("mean_value"))


@query("center_means", f"WITH {CELLS}, m AS (SELECT *, v - avg(v) OVER (PARTITION BY layer, head, channel) AS centered FROM cells) SELECT layer, head, round(sum(centered * centered), 6) AS centered_energy, round(sum(v * v), 6) AS energy FROM m GROUP BY 1, 2")
def center_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The means, layers * heads * channels rows whatever the tokens, are broadcast to the cells."""
    cells = vectors.kv_cells(spark, sf_dir)
    means = cells.groupBy("layer", "head", "channel").agg(F.avg("v").alias("mean"))
    centered = cells.join(F.broadcast(means), ["layer", "head", "channel"]).withColumn("c", F.col("v") - F.col("mean"))
    return centered.groupBy("layer", "head").agg(r6(F.sum(F.col("c") * F.col("c"))).alias("centered_energy"), r6(F.sum(F.col("v") * F.col("v"))).alias("energy"))


@query("unit_rows", f"WITH {VECS} SELECT layer, head, token, round(vec[1] / greatest(sqrt(list_sum(list_transform(vec, lambda x: x * x))), 1e-8), 9) AS unit_first FROM vecs")
def unit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.kv_vectors(spark, sf_dir).select("layer", "head", "token", F.round(unit(F.col("vec"))[0], 9).alias("unit_first"))


ROTATED = f"rotated AS (SELECT a.layer, a.head, a.token, k AS channel, sum(a.v * {HAD_SQL}) AS r FROM cells a, range(16) g(k) GROUP BY 1, 2, 3, 4)"


@query("rotate", f"WITH {CELLS}, {ROTATED} SELECT layer, head, token, channel::BIGINT AS channel, round(r, 9) AS rotated FROM rotated")
def rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = vectors.kv_vectors(spark, sf_dir).select("layer", "head", "token", F.posexplode(matrices.rotate(F.col("vec"), H16)).alias("channel", "r"))
    return turned.select("layer", "head", "token", F.col("channel").cast("long").alias("channel"), F.round("r", 9).alias("rotated"))


@query("unrotate", f"WITH {CELLS}, {ROTATED}, back AS (SELECT a.layer, a.head, a.token, k AS channel, sum(a.r * {HAD_SQL}) AS w FROM rotated a, range(16) g(k) GROUP BY 1, 2, 3, 4) SELECT layer, head, count(*) AS n_cells, round(max(abs(v - w)), 9) + 0.0 AS largest_error FROM cells JOIN back USING (layer, head, token, channel) GROUP BY 1, 2")
def unrotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turning and turning back: the largest error is zero to nine decimals."""
    vecs = vectors.kv_vectors(spark, sf_dir).withColumn("turned", matrices.rotate(F.col("vec"), H16))
    errors = vecs.select("layer", "head", F.explode(F.zip_with("vec", matrices.unrotate(F.col("turned"), H16), lambda a, b: F.abs(a - b))).alias("e"))
    return errors.groupBy("layer", "head").agg(F.count(F.lit(1)).alias("n_cells"), (F.round(F.max("e"), 9) + 0.0).alias("largest_error"))


_SIGN = "CASE WHEN ((a.head + 1) & (1 << (k % 4)::INTEGER)) = 0 THEN 1 ELSE -1 END"


@query(
    "method_rotations",
    f"""WITH {CELLS}, {ROTATED},
heads AS (SELECT a.view, a.layer, a.token, k AS channel, sum(a.v * {HAD_SQL}) * any_value({_SIGN}) AS r FROM cells a, range(16) t(k) GROUP BY 1, 2, 3, 4),
both_ AS (SELECT layer, (channel + 3 * layer) % 16 AS channel, r FROM heads),
arms AS (SELECT 'identity' AS method, layer, channel, v AS r FROM cells UNION ALL SELECT 'hadamard', layer, channel, r FROM rotated UNION ALL SELECT 'head_only', layer, channel, r FROM heads UNION ALL SELECT 'head_layer', layer, channel, r FROM both_)
SELECT method, layer, round(max(abs(r)), 6) AS peak, round(sum(r * r), 6) AS energy, round(sum(CASE WHEN channel = 0 THEN r ELSE 0 END), 6) + 0.0 AS first_channel FROM arms GROUP BY 1, 2""",
)
def method_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms of rotations: none, one for all views, one for each head, and each head's followed by one for the layer. The energy is the same under each."""
    import numpy as np

    h = np.array(H16)
    of_head = [h * np.array([-1.0 if head + 1 & 1 << k % 4 else 1.0 for k in range(vectors.DIM)]) for head in range(vectors.HEADS)]
    of_layer = [np.roll(np.eye(vectors.DIM), 3 * layer, axis=1) for layer in range(vectors.LAYERS)]
    views = range(vectors.LAYERS * vectors.HEADS)
    methods = {"identity": {v: np.eye(vectors.DIM) for v in views}, "hadamard": {v: h for v in views}, "head_only": {v: of_head[v % vectors.HEADS] for v in views}, "head_layer": {v: of_head[v % vectors.HEADS] @ of_layer[v // vectors.HEADS] for v in views}}
    vecs, out = vectors.kv_vectors(spark, sf_dir).select("layer", "view", "vec"), None
    for method, matrix in methods.items():
        arm = matrices.rotate_large(vecs, matrix).select(F.lit(method).alias("method"), "layer", F.col("vec").alias("x"))
        out = arm if out is None else out.unionByName(arm)
    return out.groupBy("method", "layer").agg(r6(F.max(F.array_max(F.transform("x", F.abs)))).alias("peak"), r6(F.sum(square_sum(F.col("x")))).alias("energy"), (r6(F.sum(F.col("x")[0])) + 0.0).alias("first_channel"))


@query("layer_shift", f"WITH {VECS}, f AS (SELECT *, count(*) OVER (PARTITION BY layer, head, block) AS n FROM vecs) SELECT layer, head, block, block * 32 + (token % 32 + layer * 3 + 1) % 32 AS shifted, token FROM f WHERE n = 32")
def layer_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The negative control: each layer's tokens turned within whole frames by its own shift."""
    vecs = vectors.kv_vectors(spark, sf_dir).select("layer", "head", "block", "token")
    whole = vecs.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("layer", "head", "block"))).filter("n = 32")
    shift = F.element_at(F.array(*[F.lit(s) for s in SHIFTS.values()]), (F.col("layer") + 1).cast("int"))
    return whole.select("layer", "head", "block", (F.col("block") * 32 + F.pmod(F.col("token") % 32 + shift, F.lit(32))).alias("shifted"), "token")


@query("sync_layers", "SELECT vec_id // 4 AS token, count(*) AS n_rows, count(DISTINCT vec_id % 4) AS n_layers, count(*) = 4 AND count(DISTINCT vec_id % 4) = 4 AS total FROM embeddings GROUP BY 1")
def sync_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.synchronized(vectors.rows(spark, sf_dir).select("layer", "token"), ["token"], "layer", vectors.LAYERS)


@query("join_moments", f"""WITH {VECS}, e AS (SELECT *, list_sum(list_transform(vec, lambda x: x * x)) AS energy FROM vecs),
m AS (SELECT block, layer, head, count(*) AS moment_count, avg(energy) AS moment FROM e GROUP BY 1, 2, 3)
SELECT e.block, e.token // 16 AS slab, e.layer, e.head, any_value(m.moment_count) AS moment_count, round(sum(e.energy) / any_value(m.moment), 6) AS relative_energy
FROM e JOIN m USING (block, layer, head) GROUP BY 1, 2, 3, 4""")
def join_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many slabs for each moment of a (block, layer, head). Slabs are summed before the join, so that it carries one row each."""
    vecs = vectors.kv_vectors(spark, sf_dir).select("block", "token", "layer", "head", square_sum(F.col("vec")).alias("energy"))
    slabs = vecs.groupBy("block", F.floor(F.col("token") / 16).cast("long").alias("slab"), "layer", "head").agg(F.sum("energy").alias("energy"))
    moments = vecs.groupBy("block", "layer", "head").agg(F.count(F.lit(1)).alias("moment_count"), F.avg("energy").alias("moment"))
    return slabs.join(moments, ["block", "layer", "head"]).select("block", "slab", "layer", "head", "moment_count", r6(F.col("energy") / F.col("moment")).alias("relative_energy"))


@query("report_left_join", "SELECT l.label, coalesce(r.n_rows, 0) AS n_rows, coalesce(r.task, 'none') AS task FROM (SELECT unnest(range(12))::INTEGER AS label) l LEFT JOIN (SELECT label, count(*) AS n_rows, 'measured' AS task FROM embeddings GROUP BY 1) r USING (label)")
def report_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every expected domain with its report, or the defaults."""
    expected = spark.range(12).select(F.col("id").cast("int").alias("label"))
    reports = spark.read.parquet(f"{sf_dir}/embeddings.parquet").groupBy("label").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("task", F.lit("measured"))
    return expected.join(reports, "label", "left").select("label", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("task", F.lit("none")).alias("task"))


@query("arm_expansion", "SELECT m.method, q.quantizer, q.bits::INTEGER AS bits, count(*) AS n_vectors FROM embeddings CROSS JOIN (VALUES ('identity'), ('head_only'), ('head_layer')) m(method) CROSS JOIN (VALUES ('fp8', 8), ('fp4', 4), ('int4', 4), ('int2', 2)) q(quantizer, bits) GROUP BY 1, 2, 3")
def arm_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods x quantizers, two short literal lists, over counts made before."""
    methods = spark.createDataFrame([(m,) for m in ("identity", "head_only", "head_layer")], "method string")
    quantizers = spark.createDataFrame([("fp8", 8), ("fp4", 4), ("int4", 4), ("int2", 2)], "quantizer string, bits int")
    counted = vectors.rows(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_vectors"))
    return counted.crossJoin(F.broadcast(methods)).crossJoin(F.broadcast(quantizers)).select("method", "quantizer", "bits", "n_vectors")


DOT = "list_sum(list_transform(range(1, 17), lambda i: a.vec[i] * b.vec[i]))"


@query("view_pairs", f"WITH {VECS} SELECT a.layer, a.head AS left_head, b.head AS right_head, count(*) AS n_pairs, round(sum({DOT}), 6) AS dot_sum FROM vecs a JOIN vecs b ON a.layer = b.layer AND a.token = b.token AND a.head < b.head GROUP BY 1, 2, 3")
def view_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of heads of a (layer, token). They stand in one row, so the pairs are taken from it without a join."""
    pairs = [(i, j) for i in range(vectors.HEADS) for j in range(i + 1, vectors.HEADS)]
    made = F.array(*[F.struct(F.lit(i).cast("long").alias("left_head"), F.lit(j).cast("long").alias("right_head"), dot(vectors.head_slice(F.col("row"), F.lit(i)), vectors.head_slice(F.col("row"), F.lit(j))).alias("d")) for i, j in pairs])
    rows = vectors.rows(spark, sf_dir).select("layer", F.explode(made).alias("p"))
    return rows.groupBy("layer", "p.left_head", "p.right_head").agg(F.count(F.lit(1)).alias("n_pairs"), r6(F.sum("p.d")).alias("dot_sum"))


@query("adjacent_layer_pairs", f"WITH {VECS} SELECT a.layer AS left_layer, a.head AS left_head, b.head AS right_head, count(*) AS n_pairs, round(sum({DOT}), 6) AS dot_sum FROM vecs a JOIN vecs b ON b.layer = a.layer + 1 AND a.token = b.token GROUP BY 1, 2, 3")
def adjacent_layer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of neighbouring layers meet once; the head pairs are made of the joined row."""
    rows = vectors.rows(spark, sf_dir).select("layer", "token", "row")
    after = rows.select((F.col("layer") - 1).alias("layer"), "token", F.col("row").alias("after"))
    made = F.array(*[F.struct(F.lit(i).cast("long").alias("left_head"), F.lit(j).cast("long").alias("right_head"), dot(vectors.head_slice(F.col("row"), F.lit(i)), vectors.head_slice(F.col("after"), F.lit(j))).alias("d")) for i in range(4) for j in range(4)])
    pairs = rows.join(after, ["layer", "token"]).select(F.col("layer").alias("left_layer"), F.explode(made).alias("p"))
    return pairs.groupBy("left_layer", "p.left_head", "p.right_head").agg(F.count(F.lit(1)).alias("n_pairs"), r6(F.sum("p.d")).alias("dot_sum"))


@query("missing_tensors", "SELECT unnest(['raw_key_samples', 'raw_sample_valid', 'raw_sample_positions', 'query_count']) AS name EXCEPT SELECT unnest(['raw_key_samples', 'raw_sample_positions']) ORDER BY 1")
def missing_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    required = spark.createDataFrame([(n,) for n in ("raw_key_samples", "raw_sample_valid", "raw_sample_positions", "query_count")], "name string")
    present = spark.createDataFrame([(n,) for n in ("raw_key_samples", "raw_sample_positions")], "name string")
    return required.join(present, "name", "left_anti")


@query("order_positions", "SELECT vec_id // 4 AS token, vec_id % 4 AS layer, row_number() OVER (PARTITION BY vec_id % 4, (vec_id // 4) // 32 ORDER BY hash_key, vec_id) - 1 AS place FROM (SELECT *, (vec_id * 7919) % 1009 AS hash_key FROM embeddings)")
def order_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Argsort of scrambled positions within each segment."""
    rows = vectors.rows(spark, sf_dir).select("layer", "token", "block", (F.col("token") * 4 + F.col("layer")).alias("id"))
    scrambled = rows.withColumn("key", F.col("id") * 7919 % 1009)
    return scrambled.select("token", "layer", (F.row_number().over(Window.partitionBy("layer", "block").orderBy("key", "id")) - 1).cast("long").alias("place"))


@query("view_order", f"WITH {VECS} SELECT (view * 5 + 3) % 16 AS place, view, count(*) AS n_rows FROM vecs GROUP BY 1, 2")
def view_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames in another order, checked to be a permutation; the order has one row for each view."""
    order = spark.range(16).select(F.col("id").alias("view"), ((F.col("id") * 5 + 3) % 16).alias("place"))
    checked = order.crossJoin(F.broadcast(order.agg(F.countDistinct("place").alias("_n")))).filter(F.when(F.col("_n") == 16, True).otherwise(F.raise_error(F.lit("not a permutation")))).drop("_n")
    return vectors.kv_vectors(spark, sf_dir).join(F.broadcast(checked), "view").groupBy("place", "view").agg(F.count(F.lit(1)).alias("n_rows"))


@query("distinct_in_order", "SELECT label, min(vec_id) AS first_seen, row_number() OVER (ORDER BY min(vec_id)) - 1 AS place FROM embeddings GROUP BY 1")
def distinct_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values in the order of their first row; the window runs over the distinct values alone."""
    firsts = spark.read.parquet(f"{sf_dir}/embeddings.parquet").groupBy("label").agg(F.min("vec_id").alias("first_seen"))
    return firsts.withColumn("place", (F.row_number().over(Window.orderBy("first_seen")) - 1).cast("long"))
