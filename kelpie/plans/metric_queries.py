"""Rate, distortion, histograms, residuals, agreement and cosines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.functions import quantizers as Q
from kelpie.functions.numeric import dot, unit
from kelpie.operators import alignment, matrices, metrics, neighbors
from kelpie.operators.scales import square_sum, with_amax_scale
from kelpie.plans.base import CELLS, QUERIES, VECS, fp4_sql, int_sql, query, r6
from kelpie.plans.codes import coded_cells, coded_rows
from kelpie.plans.scale_queries import E4M3
from kelpie.sources import vectors

FP4, INT8 = fp4_sql("block-layer"), int_sql("block-layer", 8)
ENTROPY = "coalesce(-sum(n::DOUBLE / total * log2(n::DOUBLE / total)), 0)"


@query(
    "fp4_rate_distortion",
    f"""WITH {FP4}, h AS (SELECT layer, code, count(*) AS n FROM coded GROUP BY 1, 2), t AS (SELECT layer, code, n, sum(n) OVER (PARTITION BY layer) AS total FROM h),
e AS (SELECT layer, {ENTROPY} AS bits FROM t GROUP BY 1), d AS (SELECT layer, count(*) AS n_values, count(DISTINCT block) * 2 AS scale_bytes, sum((restored - v) * (restored - v)) / greatest(sum(v * v), 1e-30) AS nmse FROM coded GROUP BY 1)
SELECT layer, n_values, scale_bytes, round(nmse, 6) AS key_nmse, round(bits, 6) AS entropy_bits, round(bits + 8.0 * scale_bytes / n_values, 6) AS entropy_bpv_estimate FROM d JOIN e USING (layer)""",
)
def fp4_rate_distortion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block-scaled FP4: distortion, order-0 entropy of the codes and, with the scales, an estimate of bits a value that is entropy, not a video size."""
    cells = coded_cells(spark, sf_dir, "fp4")
    e = F.col("restored") - F.col("v")
    # One pass over the cells: sums for each (layer, code), a few rows, from which both parts follow.
    part = cells.groupBy("layer", "code").agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("se"), F.sum(F.col("v") * F.col("v")).alias("ss"))
    totals = part.groupBy("layer").agg(F.sum("n").alias("n_values"), (F.sum("se") / F.greatest(F.sum("ss"), F.lit(1e-30))).alias("nmse"))
    bits = part.join(totals, "layer").groupBy("layer", "n_values", "nmse").agg(F.coalesce(-F.sum(F.col("n") / F.col("n_values") * F.log2(F.col("n") / F.col("n_values"))), F.lit(0.0)).alias("bits"))
    blocks = vectors.rows(spark, sf_dir).groupBy("layer").agg((F.countDistinct("block") * 2).alias("scale_bytes"))
    return bits.join(blocks, "layer").select("layer", "n_values", "scale_bytes", r6("nmse").alias("key_nmse"), r6("bits").alias("entropy_bits"), r6(F.col("bits") + F.col("scale_bytes") * 8.0 / F.col("n_values")).alias("entropy_bpv_estimate"))


@query("rd_pooled", f"WITH {FP4}, s AS (SELECT token // 16 AS slab, sum((restored - v) * (restored - v)) AS num, sum(v * v) AS den FROM coded GROUP BY 1) SELECT count(*) AS n_slabs, round(sum(num) / greatest(sum(den), 1e-30), 9) AS key_nmse, round(sqrt(sum(num) / greatest(sum(den), 1e-30)), 9) AS key_nrmse FROM s")
def rd_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerators and denominators of slabs, summed before they are divided."""
    slabs = metrics.distortion(coded_cells(spark, sf_dir, "fp4").withColumn("slab", F.floor(F.col("token") / 16)), ["slab"])
    ratio = F.sum("error_square") / F.greatest(F.sum("reference_square"), F.lit(1e-30))
    return slabs.agg(F.count(F.lit(1)).alias("n_slabs"), F.round(ratio, 9).alias("key_nmse"), F.round(F.sqrt(ratio), 9).alias("key_nrmse"))


@query("key_error", f"WITH {INT8} SELECT layer, head, round(sum((restored - v) * (restored - v)), 9) AS error_square, round(sum(v * v), 6) AS reference_square FROM coded GROUP BY 1, 2")
def key_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.distortion(coded_cells(spark, sf_dir, "int8"), ["layer", "head"])
    return out.select("layer", "head", F.round("error_square", 9).alias("error_square"), r6("reference_square").alias("reference_square"))


_MULTIPLIERS = "(VALUES (0.5::DOUBLE), (0.75), (1.0), (1.25)) m(multiplier)"
_NRMSE = f"""WITH {CELLS}, {E4M3},
o AS (SELECT label, obj, multiplier, sum(e * e) AS sse, sum(v * v) AS energy, sum((restored - v) * (restored - v)) AS fp8_sse FROM (
  SELECT label, token // 64 AS obj, multiplier, v, restored, round_even(v / (0.0078125 * multiplier), 0) * 0.0078125 * multiplier - v AS e FROM coded CROSS JOIN {_MULTIPLIERS}) GROUP BY 1, 2, 3)"""


def _nrmse_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, obj, multiplier, sse, energy, fp8_sse): four steps of a fixed grid against FP8. The arms are columns of one pass, not copies of the cells."""
    step = 0.0078125
    cells = vectors.kv_cells(spark, sf_dir).withColumn("obj", F.floor(F.col("token") / 64).cast("long"))
    f8 = Q.fp8(F.col("v"))[1] - F.col("v")
    arms = [0.5, 0.75, 1.0, 1.25]
    errors = [F.rint(F.col("v") / F.lit(step * m)) * F.lit(step) * F.lit(m) - F.col("v") for m in arms]
    sums = cells.groupBy("label", "obj").agg(F.sum(F.col("v") * F.col("v")).alias("energy"), F.sum(f8 * f8).alias("fp8_sse"), *[F.sum(e * e).alias(f"s{i}") for i, e in enumerate(errors)])
    pairs = F.array(*[F.struct(F.lit(m).alias("multiplier"), F.col(f"s{i}").alias("sse")) for i, m in enumerate(arms)])
    return sums.select("label", "obj", "energy", "fp8_sse", F.explode(pairs).alias("a")).select("label", "obj", "a.multiplier", "a.sse", "energy", "fp8_sse")


@query("nrmse_domain", f"{_NRMSE} SELECT label, multiplier, round(sqrt(sum(sse) / sum(energy)), 6) AS nrmse, round(sqrt(sum(fp8_sse) / sum(energy)), 6) AS fp8_nrmse, round(max(sqrt(sse / energy)), 6) AS worst_object_nrmse FROM o GROUP BY 1, 2")
def nrmse_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = _nrmse_objects(spark, sf_dir)
    return objects.groupBy("label", "multiplier").agg(r6(F.sqrt(F.sum("sse") / F.sum("energy"))).alias("nrmse"), r6(F.sqrt(F.sum("fp8_sse") / F.sum("energy"))).alias("fp8_nrmse"), r6(F.max(F.sqrt(F.col("sse") / F.col("energy")))).alias("worst_object_nrmse"))


@query("nrmse_pooled", f"{_NRMSE} SELECT multiplier, round(sqrt(sum(sse) / sum(energy)), 6) AS nrmse, round(sqrt(sum(fp8_sse) / sum(energy)), 6) AS fp8_nrmse FROM o GROUP BY 1")
def nrmse_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nrmse_objects(spark, sf_dir).groupBy("multiplier").agg(r6(F.sqrt(F.sum("sse") / F.sum("energy"))).alias("nrmse"), r6(F.sqrt(F.sum("fp8_sse") / F.sum("energy"))).alias("fp8_nrmse"))


_KIND = "CASE WHEN head < 2 THEN 'key' ELSE 'value' END"


@query(
    "nrmse_by_kind",
    f"WITH {CELLS}, {E4M3} SELECT label, kind, multiplier, round(sqrt(sum(e * e) / sum(v * v)), 6) AS nrmse, round(sqrt(sum((restored - v) * (restored - v)) / sum(v * v)), 6) AS fp8_nrmse, round(sum(v * v), 6) AS energy FROM ("
    f"SELECT label, {_KIND} AS kind, multiplier, v, restored, round_even(v / (0.0078125 * multiplier), 0) * 0.0078125 * multiplier - v AS e FROM coded CROSS JOIN {_MULTIPLIERS}) GROUP BY 1, 2, 3",
)
def nrmse_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The errors of each domain and multiplier, split into keys and values; the arms are columns of one pass."""
    step, arms = 0.0078125, [0.5, 0.75, 1.0, 1.25]
    cells = vectors.kv_cells(spark, sf_dir).withColumn("kind", F.when(F.col("head") < 2, "key").otherwise("value"))
    f8 = Q.fp8(F.col("v"))[1] - F.col("v")
    errors = [F.rint(F.col("v") / F.lit(step * m)) * F.lit(step) * F.lit(m) - F.col("v") for m in arms]
    sums = cells.groupBy("label", "kind").agg(F.sum(F.col("v") * F.col("v")).alias("energy"), F.sum(f8 * f8).alias("fp8_sse"), *[F.sum(e * e).alias(f"s{i}") for i, e in enumerate(errors)])
    each = sums.select("label", "kind", "energy", "fp8_sse", F.explode(F.array(*[F.struct(F.lit(m).alias("multiplier"), F.col(f"s{i}").alias("sse")) for i, m in enumerate(arms)])).alias("a"))
    return each.select("label", "kind", "a.multiplier", r6(F.sqrt(F.col("a.sse") / F.col("energy"))).alias("nrmse"), r6(F.sqrt(F.col("fp8_sse") / F.col("energy"))).alias("fp8_nrmse"), r6("energy").alias("energy"))


@query(
    "rd_points",
    f"WITH {CELLS}, q AS (SELECT multiplier, v, round_even(v / (0.0078125 * multiplier), 0) AS k FROM cells CROSS JOIN {_MULTIPLIERS}), d AS (SELECT multiplier, sqrt(sum((k * 0.0078125 * multiplier - v) * (k * 0.0078125 * multiplier - v)) / sum(v * v)) AS nrmse FROM q GROUP BY 1), "
    f"h AS (SELECT multiplier, k, count(*) AS n FROM q GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY multiplier) AS total FROM h), e AS (SELECT multiplier, {ENTROPY} AS bits FROM t GROUP BY 1) "
    "SELECT row_number() OVER (ORDER BY nrmse) AS place, multiplier, round(nrmse, 6) AS nrmse, round(bits, 6) AS entropy_bpv FROM d JOIN e USING (multiplier)",
)
def rd_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate and distortion of each step of a fixed grid, in the order of their errors; the rate is the entropy of the codes, no video size. Sums of each (step, code), a few rows, give both."""
    from pyspark.sql.window import Window

    step, arms = 0.0078125, [0.5, 0.75, 1.0, 1.25]
    codes = F.array(*[F.struct(F.lit(m).alias("multiplier"), F.rint(F.col("v") / F.lit(step * m)).alias("k")) for m in arms])
    cells = vectors.kv_cells(spark, sf_dir).select("v", F.explode(codes).alias("q")).select("v", "q.multiplier", "q.k")
    e = F.col("k") * F.lit(step) * F.col("multiplier") - F.col("v")
    part = cells.groupBy("multiplier", "k").agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"), F.sum(F.col("v") * F.col("v")).alias("ss"))
    totals = part.groupBy("multiplier").agg(F.sum("n").alias("total"), F.sqrt(F.sum("sse") / F.sum("ss")).alias("nrmse"))
    p = F.col("n") / F.col("total")
    bits = part.join(F.broadcast(totals), "multiplier").groupBy("multiplier", "nrmse").agg((-F.sum(p * F.log2(p))).alias("bits"))  # a line for each step
    return bits.select(F.row_number().over(Window.orderBy("nrmse")).cast("long").alias("place"), "multiplier", r6("nrmse").alias("nrmse"), r6("bits").alias("entropy_bpv")).orderBy("place")


@query("code_histogram", f"WITH {FP4}, c AS (SELECT code, count(*) AS n FROM coded GROUP BY 1) SELECT k::INTEGER AS code, coalesce(n, 0) AS n FROM range(16) g(k) LEFT JOIN c ON c.code = k")
def code_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(coded_cells(spark, sf_dir, "fp4"), [], 16)


@query("code_entropy", f"WITH {INT8}, c AS (SELECT layer, code, count(*) AS n FROM coded GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY layer) AS total FROM c) SELECT layer, round({ENTROPY}, 6) AS entropy_bits, count(*) AS unique_symbols, sum(n)::BIGINT AS n_values FROM t GROUP BY 1")
def code_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.code_entropy(coded_cells(spark, sf_dir, "int8"), ["layer"]).withColumn("entropy_bits", r6("entropy_bits"))


@query("rate_surface", f"WITH {INT8} SELECT layer, code >> 4 AS high_code, count(*) AS n FROM coded GROUP BY 1, 2")
def rate_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = coded_cells(spark, sf_dir, "int8")
    return cells.groupBy("layer", F.shiftright("code", 4).alias("high_code")).agg(F.count(F.lit(1)).alias("n"))


_LAG = {"token": "PARTITION BY view, channel ORDER BY token", "view": "PARTITION BY token, channel ORDER BY view", "channel": "PARTITION BY view, token ORDER BY channel"}


def _axis_queries(axis: str) -> None:
    pairs = f"p AS (SELECT code, before FROM (SELECT code, lag(code) OVER ({_LAG[axis]}) AS before FROM coded) WHERE before IS NOT NULL)"

    @query(f"cond_entropy_{axis}", f"WITH {INT8}, {pairs}, j AS (SELECT before, code, count(*) AS n FROM p GROUP BY 1, 2), t AS (SELECT n, sum(n) OVER (PARTITION BY before) AS row_n, sum(n) OVER () AS total FROM j) SELECT round(-sum(n::DOUBLE / total * log2(n::DOUBLE / row_n)), 6) AS conditional_entropy_bits, max(total)::BIGINT AS pair_count FROM t")
    def conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = neighbors.pairs(coded_rows(spark, sf_dir, "int8"), axis)
        return metrics.conditional_entropy(found).withColumn("conditional_entropy_bits", r6("conditional_entropy_bits"))

    @query(
        f"residual_stats_{axis}",
        f"WITH {INT8}, {pairs}, c AS (SELECT code - before AS r, count(*) AS n FROM p GROUP BY 1), t AS (SELECT r, n, sum(n) OVER () AS total FROM c) SELECT round({ENTROPY}, 6) AS residual_entropy_bits, round(sum(abs(r) * n)::DOUBLE / sum(n), 6) AS absolute_residual_mean, "
        "round(sum(CASE WHEN r = 0 THEN n ELSE 0 END)::DOUBLE / sum(n), 6) AS zero_residual_fraction, sum(n)::BIGINT AS pair_count, count(*) AS unique_residuals FROM t",
    )
    def residual(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = metrics.residual_statistics(neighbors.pairs(coded_rows(spark, sf_dir, "int8"), axis))
        return found.select(r6("residual_entropy_bits").alias("residual_entropy_bits"), r6("absolute_residual_mean").alias("absolute_residual_mean"), r6("zero_residual_fraction").alias("zero_residual_fraction"), "pair_count", "unique_residuals")

    if axis != "channel":

        @query(f"adjacent_residual_{axis}", f"WITH {INT8}, {pairs} SELECT round(avg(log2(1 + abs(code - before) / 16.0::DOUBLE)), 6) AS bits_per_pair, count(*) AS pair_count FROM p")
        def adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
            return neighbors.adjacent_bits(neighbors.pairs(coded_rows(spark, sf_dir, "int8"), axis)).withColumn("bits_per_pair", r6("bits_per_pair"))


for _axis in _LAG:
    _axis_queries(_axis)


def _rate_sql(coded: str, neutral: float, scale: float, both: bool = False) -> str:
    cost = lambda x: f"log2(1 + abs({x}) / {scale}::DOUBLE)"
    soft = lambda m: f"least({', '.join(m)}) - ln({' + '.join(f'exp(least({', '.join(m)}) - {x})' for x in m)})"
    modes = ["l", "u", "pl", "pv"] + ["bi"] * both
    low = f"least({', '.join(modes)})"
    whole = " + ".join(f"exp({low} - {m})" for m in modes)
    inter = "least(pv, bi)" if both else "pv"
    last = vectors.LAYERS * vectors.HEADS - 1
    following = f", lead(code::DOUBLE, 1, {neutral}) OVER (PARTITION BY token, channel ORDER BY view) AS xn" if both else ""
    sided = f", CASE WHEN view IN (0, {last}) THEN 8192.0 ELSE sum({cost('c - (xp + xn) * 0.5')}) END AS bi" if both else ""
    return f"""WITH {coded},
near AS (SELECT view, token, channel, code::DOUBLE AS c, lag(code::DOUBLE, 1, {neutral}) OVER (PARTITION BY view, token ORDER BY channel) AS xl, lag(code::DOUBLE, 1, {neutral}) OVER (PARTITION BY view, channel ORDER BY token) AS xu,
         lag(code::DOUBLE, 1, {neutral}) OVER (PARTITION BY token, channel ORDER BY view) AS xp{following} FROM coded),
costs AS (SELECT view, token // 16 AS y, channel // 16 AS x, sum({cost("c - xl")}) AS l, sum({cost("c - xu")}) AS u, sum({cost("c - (xl + xu) * 0.5")}) AS pl, CASE WHEN view = 0 THEN 8192.0 ELSE sum({cost("c - xp")}) END AS pv{sided} FROM near GROUP BY 1, 2, 3),
n AS (SELECT count(*) AS n FROM coded)
SELECT round(sum({soft(modes)}) / any_value(n), 6) AS total_bits, round(sum({soft(modes[:3])}) / any_value(n), 6) AS intra_bits, round(sum({inter}) / any_value(n), 6) AS inter_bits,
       round(avg(exp({low} - l) / ({whole})), 6) AS p_left, round(avg(exp({low} - u) / ({whole})), 6) AS p_up, round(avg(exp({low} - pl) / ({whole})), 6) AS p_planar, round(avg(exp({low} - pv) / ({whole})), 6) AS p_previous{f", round(avg(exp({low} - bi) / ({whole})), 6) AS p_bidirectional" if both else ""} FROM costs, n"""


def _rate_query(name: str, quantizer: str, coded: str, both: bool = False) -> None:
    neutral, scale = Q.NEUTRAL[quantizer]

    @query(name, _rate_sql(coded, neutral, scale, both))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = neighbors.rate_proxy(coded_rows(spark, sf_dir, quantizer), neutral, scale, layers=vectors.LAYERS if both else 0)
        return out.select(*[r6(c).alias(c) for c in out.columns])


_rate_query("rate_proxy", "fp4", FP4)
_rate_query("rate_proxy_int8", "int8", INT8)
_rate_query("rate_proxy_int4", "int4", int_sql("block-layer", 4))
_rate_query("rate_proxy_bidirectional", "fp4", FP4, True)


def _mae(name: str, before: str, axis: str) -> None:
    @query(name, f"WITH {INT8}, p AS (SELECT code, {before} AS before FROM coded) SELECT round(avg(abs(code - before) / 255.0::DOUBLE), 6) AS mae_normalized, count(*) AS pair_count FROM p WHERE before IS NOT NULL")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = neighbors.pairs(coded_rows(spark, sf_dir, "int8"), axis)
        return found.agg(r6(F.avg(F.abs(F.col("code") - F.col("before")) / F.lit(255.0))).alias("mae_normalized"), F.count(F.lit(1)).alias("pair_count"))


_mae("h265_mae_horizontal", "lag(code) OVER (PARTITION BY layer, token ORDER BY channel * 4 + head)", "interleaved")
_mae("h265_mae_vertical", "lag(code) OVER (PARTITION BY layer, head, channel ORDER BY token)", "token")
_mae("h265_mae_inter", "lag(code) OVER (PARTITION BY token, head, channel ORDER BY layer)", "layer")


def _agreement(name: str, on_sql: str, left_key: str, shift: int, same_head: bool, within: bool) -> None:
    @query(name, f"WITH {INT8} SELECT a.layer AS left_layer, round(avg((a.code = b.code)::INTEGER), 6) AS agreement, count(*) AS pair_count FROM coded a JOIN coded b ON {on_sql} GROUP BY 1")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """The heads of a (layer, token, channel) are gathered first (a bounded few), so that one narrow join or none is left."""
        cells = coded_cells(spark, sf_dir, "int8").select("layer", "token", "channel", "head", "code")
        wide = cells.groupBy("layer", "token", "channel").agg(*[F.max(F.when(F.col("head") == h, F.col("code"))).alias(f"h{h}") for h in range(vectors.HEADS)])
        heads = range(vectors.HEADS)
        if within:
            pairs = [(F.col(f"h{i}"), F.col(f"h{j}")) for i in heads for j in heads if i < j]
            joined = wide
        else:
            after = wide.select((F.col("layer") - shift).alias("layer"), "token", "channel", *[F.col(f"h{h}").alias(f"g{h}") for h in heads])
            joined = wide.join(after, ["layer", "token", "channel"])
            pairs = [(F.col(f"h{i}"), F.col(f"g{j}")) for i in heads for j in heads if i == j or not same_head]
        equal = sum(((a == b).cast("int") for a, b in pairs[1:]), (pairs[0][0] == pairs[0][1]).cast("int"))
        return joined.groupBy(F.col("layer").alias("left_layer")).agg(r6(F.sum(equal) / (F.count(F.lit(1)) * len(pairs))).alias("agreement"), (F.count(F.lit(1)) * len(pairs)).alias("pair_count"))


_agreement("code_agreement_heads", "a.layer = b.layer AND a.token = b.token AND a.channel = b.channel AND a.head < b.head", "layer", 0, False, True)
_agreement("code_agreement_layers_same", "b.layer = a.layer + 1 AND a.token = b.token AND a.channel = b.channel AND a.head = b.head", "layer", 1, True, False)
_agreement("code_agreement_layers_all", "b.layer = a.layer + 1 AND a.token = b.token AND a.channel = b.channel", "layer", 1, False, False)

UNIT = f"{VECS}, units AS (SELECT *, list_transform(vec, lambda x: x / greatest(sqrt(list_sum(list_transform(vec, lambda y: y * y))), 1e-8)) AS u FROM vecs)"
UDOT = "list_sum(list_transform(range(1, 17), lambda i: a.u[i] * b.u[i]))"


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.kv_vectors(spark, sf_dir).select("layer", "token", "block", "head", unit(F.col("vec")).alias("u"))


def _cosine(name: str, on_sql: str, on, *, chunk: bool = False) -> None:
    @query(name, f"WITH {UNIT} SELECT a.layer AS left_layer, round(sum({UDOT}), 6) AS cosine_sum, count(*) AS pair_count FROM units a JOIN units b ON {on_sql} GROUP BY 1")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a, b = _units(spark, sf_dir).alias("a"), _units(spark, sf_dir).alias("b")
        joined = a.join(b, on())
        return joined.groupBy(F.col("a.layer").alias("left_layer")).agg(r6(F.sum(dot(F.col("a.u"), F.col("b.u")))).alias("cosine_sum"), F.count(F.lit(1)).alias("pair_count"))


_EQ = lambda *names: [F.col(f"a.{n}") == F.col(f"b.{n}") for n in names]


def _all(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


_NEXT = lambda: F.col("b.layer") == F.col("a.layer") + 1
_cosine("cosine_within_layer", "a.layer = b.layer AND a.token = b.token AND a.head < b.head", lambda: _all([*_EQ("layer", "token"), F.col("a.head") < F.col("b.head")]))
_cosine("cosine_adjacent_layer_same", "b.layer = a.layer + 1 AND a.token = b.token AND a.head = b.head", lambda: _all([_NEXT(), *_EQ("token", "head")]))
_cosine("cosine_adjacent_layer_all", "b.layer = a.layer + 1 AND a.token = b.token", lambda: _all([_NEXT(), *_EQ("token")]))
_cosine("cosine_adjacent_token", "a.layer = b.layer AND a.head = b.head AND a.block = b.block AND b.token = a.token + 1", lambda: _all([*_EQ("layer", "head", "block"), F.col("b.token") == F.col("a.token") + 1]))



@query("cosine_adjacent_token_rotated", f"WITH {VECS}, had AS (SELECT i, j, CASE WHEN bit_count((i & j)::BIGINT) % 2 = 0 THEN 0.25 ELSE -0.25 END::DOUBLE AS h FROM range(16) a(i), range(16) b(j)), hm AS (SELECT j, list(h ORDER BY i) AS col FROM had GROUP BY 1), hl AS (SELECT list(col ORDER BY j) AS cols FROM hm), turned AS (SELECT layer, token, block, head, list_transform(cols, lambda c: list_sum(list_transform(range(1, 17), lambda i: vec[i] * c[i]))) AS vec FROM vecs, hl), units AS (SELECT *, list_transform(vec, lambda x: x / greatest(sqrt(list_sum(list_transform(vec, lambda y: y * y))), 1e-8)) AS u FROM turned) SELECT a.layer AS left_layer, round(sum({UDOT}), 6) AS cosine_sum, count(*) AS pair_count FROM units a JOIN units b ON a.layer = b.layer AND a.head = b.head AND a.block = b.block AND b.token = a.token + 1 GROUP BY 1")
def cosine_adjacent_token_rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cosines of neighbouring tokens after a rotation, which an orthogonal one must leave as they were."""
    turned = vectors.kv_vectors(spark, sf_dir).withColumn("vec", matrices.rotate(F.col("vec"), matrices.hadamard(vectors.DIM)))
    units = turned.select("layer", "token", "block", "head", unit(F.col("vec")).alias("u"))
    joined = units.alias("a").join(units.alias("b"), _all([*_EQ("layer", "head", "block"), F.col("b.token") == F.col("a.token") + 1]))
    return joined.groupBy(F.col("a.layer").alias("left_layer")).agg(r6(F.sum(dot(F.col("a.u"), F.col("b.u")))).alias("cosine_sum"), F.count(F.lit(1)).alias("pair_count"))


TEMPLATES = f"""{CELLS}, cm AS (SELECT layer, token, channel, avg(v) AS m FROM cells GROUP BY 1, 2, 3),
tl AS (SELECT layer, token, list(m ORDER BY channel) AS vec FROM cm GROUP BY 1, 2),
units AS (SELECT layer, token, list_transform(vec, lambda x: x / greatest(sqrt(list_sum(list_transform(vec, lambda y: y * y))), 1e-8)) AS u FROM tl)"""


def _template(name: str, condition: str, on) -> None:
    @query(name, f"WITH {TEMPLATES} SELECT a.layer AS left_layer, b.layer AS right_layer, round(sum({UDOT}), 6) AS cosine_sum, count(*) AS pair_count FROM units a JOIN units b ON a.token = b.token AND {condition} GROUP BY 1, 2")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = alignment.templates(vectors.kv_vectors(spark, sf_dir)).withColumnRenamed("vec", "u")
        joined = found.alias("a").join(found.alias("b"), _all(_EQ("token")) & on())
        return joined.groupBy(F.col("a.layer").alias("left_layer"), F.col("b.layer").alias("right_layer")).agg(r6(F.sum(dot(F.col("a.u"), F.col("b.u")))).alias("cosine_sum"), F.count(F.lit(1)).alias("pair_count"))


_template("cosine_template_adjacent", "b.layer = a.layer + 1", _NEXT)
_template("cosine_template_all", "a.layer < b.layer", lambda: F.col("a.layer") < F.col("b.layer"))


@query(
    "cosine_shuffled",
    f"""WITH {UNIT}, f AS (SELECT *, count(*) OVER (PARTITION BY layer, head, block) AS n FROM units)
SELECT a.layer AS left_layer, round(sum({UDOT}), 6) AS cosine_sum, count(*) AS pair_count FROM f a JOIN f b
ON b.layer = a.layer + 1 AND a.head = b.head AND a.block = b.block AND b.token % 32 = ((a.token % 32) - (CASE WHEN 7 % a.n = 0 THEN 1 ELSE 7 % a.n END) + a.n) % a.n GROUP BY 1""",
)
def cosine_shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The null control: the right side's tokens turned within each chunk."""
    sizes = vectors.rows(spark, sf_dir).groupBy("layer", "block").agg(F.count(F.lit(1)).alias("n"))
    a = _units(spark, sf_dir).join(F.broadcast(sizes), ["layer", "block"]).withColumn("at", alignment.rolled(F.col("token") % 32, F.lit(7), F.col("n")))
    b = _units(spark, sf_dir).select((F.col("layer") - 1).alias("layer"), "block", "head", (F.col("token") % 32).alias("at"), F.col("u").alias("w"))
    joined = a.join(b, ["layer", "block", "head", "at"])
    return joined.groupBy(F.col("layer").alias("left_layer")).agg(r6(F.sum(dot(F.col("u"), F.col("w")))).alias("cosine_sum"), F.count(F.lit(1)).alias("pair_count"))


@query(
    "pair_details",
    f"""WITH {UNIT}, p AS (SELECT a.layer AS left_layer, round(sum(CASE WHEN a.head = b.head THEN {UDOT} END), 6) AS same_head_sum, sum((a.head = b.head)::INTEGER)::BIGINT AS same_head_count, round(sum({UDOT}), 6) AS all_head_sum, count(*) AS all_head_count FROM units a JOIN units b ON b.layer = a.layer + 1 AND a.token = b.token GROUP BY 1),
tc AS (SELECT * FROM ({TEMPLATES.replace("units AS", "tunits AS").join(("WITH ", f" SELECT a.layer AS left_layer, round(sum({UDOT}), 6) AS template_sum, count(*) AS template_count FROM tunits a JOIN tunits b ON a.token = b.token AND b.layer = a.layer + 1 GROUP BY 1"))}))
SELECT * FROM p JOIN tc USING (left_layer)""",
)
def pair_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each pair of neighbouring layers the cosines of the same head, of all heads and of the heads' templates."""
    a, b = _units(spark, sf_dir).alias("a"), _units(spark, sf_dir).alias("b")
    c, same = dot(F.col("a.u"), F.col("b.u")), F.col("a.head") == F.col("b.head")
    joined = a.join(b, _all([_NEXT(), *_EQ("token")])).select(F.col("a.layer").alias("left_layer"), c.alias("c"), same.alias("same"))
    heads = joined.groupBy("left_layer").agg(r6(F.sum(F.when(F.col("same"), F.col("c")))).alias("same_head_sum"), F.sum(F.col("same").cast("long")).alias("same_head_count"), r6(F.sum("c")).alias("all_head_sum"), F.count(F.lit(1)).alias("all_head_count"))
    found = QUERIES["cosine_template_adjacent"](spark, sf_dir).select("left_layer", F.col("cosine_sum").alias("template_sum"), F.col("pair_count").alias("template_count"))
    return heads.join(F.broadcast(found), "left_layer")  # a line for each layer


@query("mean_metric", "SELECT event_type AS name, round(sum(value), 4) AS metric_sum, count(*) AS metric_count, round(sum(value) / greatest(count(*), 1), 6) AS mean_value FROM events GROUP BY 1")
def mean_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy(F.col("event_type").alias("name")).agg(F.round(F.sum("value"), 4).alias("metric_sum"), F.count(F.lit(1)).alias("metric_count"), r6(F.sum("value") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("mean_value"))


@query(
    "throughput_median",
    "WITH r AS (SELECT event_type AS domain, user_id % 5 AS repeat, sum(value) + 1 AS seconds, count(*) * 4096 AS n_bytes FROM events GROUP BY 1, 2), k AS (SELECT * FROM r WHERE repeat > 0), s AS (SELECT repeat, sum(seconds) AS seconds, sum(n_bytes) AS n_bytes FROM k GROUP BY 1) "
    "SELECT round(sum(n_bytes) / count(*) / median(seconds) / 1e9, 9) AS gb_per_second, count(*) AS repeats FROM s",
)
def throughput_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes over the median of the repeats' total seconds; the first repeat is a warm-up."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("user_id % 5 > 0")
    domains = events.groupBy(F.col("event_type").alias("domain"), (F.col("user_id") % 5).alias("repeat")).agg((F.sum("value") + 1).alias("seconds"), (F.count(F.lit(1)) * 4096).alias("n_bytes"))
    repeats = domains.groupBy("repeat").agg(F.sum("seconds").alias("seconds"), F.sum("n_bytes").alias("n_bytes"))
    return repeats.agg(F.round(F.sum("n_bytes") / F.count(F.lit(1)) / F.median("seconds") / F.lit(1e9), 9).alias("gb_per_second"), F.count(F.lit(1)).alias("repeats"))


_ARMS = (("fp4", FP4), ("int8", INT8), ("int4", int_sql("block-layer", 4)))
_ARM_SQL = " UNION ALL ".join(
    f"""SELECT '{arm}' AS arm, * FROM (WITH {sql}, h AS (SELECT code, count(*) AS n FROM coded GROUP BY 1), t AS (SELECT n, sum(n) OVER () AS total FROM h), e AS (SELECT {ENTROPY} AS bits FROM t),
g AS (SELECT layer, head, block, sum((restored - v) * (restored - v)) AS sse, sum(v * v) AS ss FROM coded GROUP BY 1, 2, 3),
q AS (SELECT sum(ee * vv) AS qe, sum(vv * vv) AS qv FROM (SELECT sum((a.restored - a.v) * (b.restored - b.v)) AS ee, sum(a.v * b.v) AS vv FROM coded a JOIN coded b ON a.layer = b.layer AND a.head = b.head AND a.token = b.token GROUP BY a.layer, a.head, a.block, a.channel, b.channel)),
d AS (SELECT count(DISTINCT (layer, block)) * 2 AS metadata_bytes, sum(sse) / greatest(sum(ss), 1e-30) AS key_nmse FROM g)
SELECT (SELECT any_value(total) FROM t)::BIGINT AS n_values, ceil((SELECT any_value(total) FROM t) * round(bits, 9) / 8)::BIGINT AS bitstream_bytes, metadata_bytes, key_nmse, qe / qv AS qk_nmse FROM e, d, q)"""
    for arm, sql in _ARMS
)
_SUMMARY = f"s AS ({_ARM_SQL}), t AS (SELECT *, bitstream_bytes + metadata_bytes AS total_bytes FROM s)"


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(arm, n_values, bitstream_bytes, metadata_bytes, key_nmse, qk_nmse, ...) of three quantizers: the bitstream is the order-0 entropy of their codes over the whole table, no video size."""
    out = None
    for arm, _ in _ARMS:
        cells = coded_cells(spark, sf_dir, arm)
        e = F.col("restored") - F.col("v")
        part = cells.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("sse"), F.sum(F.col("v") * F.col("v")).alias("ss"))  # a row for each code
        total = part.agg(F.sum("n").alias("n_values"), (F.sum("sse") / F.greatest(F.sum("ss"), F.lit(1e-30))).alias("key_nmse"))
        p = F.col("n") / F.col("n_values")
        bits = part.crossJoin(F.broadcast(total)).groupBy("n_values", "key_nmse").agg((-F.sum(p * F.log2(p))).alias("bits"))
        scaled = with_amax_scale(vectors.rows(spark, sf_dir), "block-layer", Q.REGISTRY[arm][1])
        blocks = scaled.groupBy("layer", "block").agg(F.min("scale").alias("scale"), F.collect_list("row").alias("rows"))  # a block has 32 rows
        forms = matrices.block_forms(blocks, "layer", "rows", "scale", vectors.HEADS, arm)
        quality = forms.agg((F.sum("error_form") / F.sum("reference_form")).alias("qk_nmse"))
        scales = vectors.rows(spark, sf_dir).agg((F.count_distinct("layer", "block") * 2).alias("metadata_bytes"))
        row = bits.crossJoin(F.broadcast(quality)).crossJoin(F.broadcast(scales)).select(F.lit(arm).alias("arm"), "n_values", F.ceil(F.col("n_values") * F.round("bits", 9) / 8).cast("long").alias("bitstream_bytes"), "metadata_bytes", "key_nmse", "qk_nmse")  # one row each
        out = row if out is None else out.unionByName(row)
    return metrics.rate_summary(out)


@query("rate_summary", f"WITH {_SUMMARY} SELECT arm, n_values, bitstream_bytes, metadata_bytes, total_bytes, round(8.0 * total_bytes / n_values, 6) AS bits_per_value, round(2.0 * n_values / total_bytes, 6) AS ratio_vs_bf16, round(key_nmse, 9) AS key_nmse, round(qk_nmse, 9) AS qk_nmse FROM t")
def rate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates and distortions of three quantizers, measured on their codes."""
    return _summary(spark, sf_dir).select("arm", "n_values", "bitstream_bytes", "metadata_bytes", "total_bytes", r6("bits_per_value").alias("bits_per_value"), r6("ratio_vs_bf16").alias("ratio_vs_bf16"), F.round("key_nmse", 9).alias("key_nmse"), F.round("qk_nmse", 9).alias("qk_nmse"))


@query("vs_baseline", f"WITH {_SUMMARY} SELECT a.arm, a.total_bytes, round((b.total_bytes - a.total_bytes)::DOUBLE / b.total_bytes, 6) AS total_bytes_vs_baseline, round((a.qk_nmse - b.qk_nmse) / b.qk_nmse, 6) AS qk_nmse_change, round((a.key_nmse - b.key_nmse) / b.key_nmse, 6) AS key_nmse_change FROM t a, t b WHERE b.arm = 'fp4'")
def vs_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes saved against the first arm, and how its errors change."""
    out = metrics.against_baseline(_summary(spark, sf_dir).select("arm", "total_bytes", "qk_nmse", "key_nmse"), "arm", "fp4", ["total_bytes", "qk_nmse", "key_nmse"])
    return out.select("arm", "total_bytes", r6("total_bytes_vs_baseline").alias("total_bytes_vs_baseline"), r6(-F.col("qk_nmse_vs_baseline")).alias("qk_nmse_change"), r6(-F.col("key_nmse_vs_baseline")).alias("key_nmse_change"))


@query("energy_by_kind", f"WITH {VECS}, e AS (SELECT CASE WHEN head < 2 THEN 'key' ELSE 'value' END AS kind, list_sum(list_transform(vec, lambda x: x * x)) AS energy FROM vecs) SELECT coalesce(kind, 'total') AS kind, count(*) AS n_vectors, round(sum(energy), 6) AS energy FROM e GROUP BY ROLLUP (kind)")
def energy_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind and the total, in one pass."""
    vecs = vectors.kv_vectors(spark, sf_dir).select(F.when(F.col("head") < 2, "key").otherwise("value").alias("kind"), square_sum(F.col("vec")).alias("energy"))
    return vecs.rollup("kind").agg(F.count(F.lit(1)).alias("n_vectors"), r6(F.sum("energy")).alias("energy")).withColumn("kind", F.coalesce("kind", F.lit("total")))
