"""Scales and quantizers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.functions import quantizers as Q
from kelpie.functions.numeric import bf16
from kelpie.operators import scales
from kelpie.operators.metrics import distortion
from kelpie.plans.base import CELLS, SCALE_KEYS, below_sql, bf16_sql, exp_sql, fp4_sql, int_sql, pick_sql, query, r6, scale_sql
from kelpie.plans.codes import coded_cells
from kelpie.sources import vectors

CODED = ["layer", "token", "head", "channel", "code"]


def _amax_query(granularity: str) -> None:
    keys = SCALE_KEYS[granularity]
    name = "amax_scale_" + granularity.replace("-", "_")

    @query(name, f"WITH {CELLS} SELECT {keys}, max(abs(v)) AS amax, {scale_sql('max(abs(v))', 6.0)} AS scale FROM cells GROUP BY {keys}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if granularity == "block-view":
            return scales.amax_scales(vectors.kv_vectors(spark, sf_dir), granularity, 6.0, array="vec")
        return scales.amax_scales(vectors.rows(spark, sf_dir), granularity, 6.0)


for _g in SCALE_KEYS:
    _amax_query(_g)

_RAW = "greatest(amax / 6.0, pow(2.0, -127))"


@query(
    "amax_channel_group",
    f"WITH {CELLS}, g AS (SELECT layer, head, token, (channel // 4)::INTEGER AS \"group\", max(abs(v)) AS amax FROM cells GROUP BY 1, 2, 3, 4) SELECT *, {scale_sql('amax', 6.0)} AS scale_bf16, "
    f"CASE WHEN amax > 0 THEN pow(2.0, {exp_sql(_RAW)} + CASE WHEN pow(2.0, {exp_sql(_RAW)}) = {_RAW} THEN 0 ELSE 1 END) ELSE 1.0 END AS scale_ue8m0 FROM g",
)
def amax_channel_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scales.channel_group_scales(vectors.kv_vectors(spark, sf_dir).select("layer", "head", "token", "vec"), 4, 6.0)


RMS = f"CASE WHEN sqrt(avg(v * v)) > 0 THEN {bf16_sql('sqrt(avg(v * v))')} ELSE 1.0 END"


@query("rms_scale_block", f"WITH {CELLS} SELECT layer, block, round(sqrt(avg(v * v)), 9) AS rms, {RMS} AS scale FROM cells GROUP BY 1, 2")
def rms_scale_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scales.rms_scales(vectors.rows(spark, sf_dir), ["layer", "block"]).withColumn("rms", F.round("rms", 9))


@query("rms_scale_vector", f"WITH {CELLS} SELECT layer, head, token, {RMS} AS scale FROM cells GROUP BY 1, 2, 3")
def rms_scale_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.kv_vectors(spark, sf_dir).select("layer", "head", "token", scales.rms_scale_of_row(F.col("vec")).alias("scale"))


@query(
    "view_scale_up",
    f"""WITH {CELLS}, s AS (SELECT token // 256 AS obj, view, sqrt(12.0::DOUBLE) * 0.0267 * sqrt(avg(v * v)) AS error, max(abs(v)) / 127.0 AS floor_ FROM cells GROUP BY 1, 2),
t AS (SELECT *, greatest(error, floor_) AS target FROM s)
SELECT obj, view, round(error, 9) AS error, round(floor_, 9) AS floor, CASE WHEN target > 0 THEN {bf16_sql("target", True)} ELSE 1.0 END AS scale, (floor_ >= error)::INTEGER AS floor_wins FROM t""",
)
def view_scale_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = vectors.kv_vectors(spark, sf_dir).withColumn("obj", F.floor(F.col("token") / 256).cast("long"))
    return scales.view_scales_up(vecs, ["obj", "view"], 0.0267).withColumn("error", F.round("error", 9)).withColumn("floor", F.round("floor", 9))


def _code_query(name: str, quantizer: str, granularity: str, sql: str) -> None:
    @query(name, f"WITH {sql} SELECT layer, token, head, channel, code::INTEGER AS code, round(restored, 9) AS restored FROM coded")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return coded_cells(spark, sf_dir, quantizer, granularity).select(*CODED, F.round("restored", 9).alias("restored"))


_code_query("q_fp4", "fp4", "block-layer", fp4_sql("block-layer"))
_code_query("q_fp4_block_view", "fp4", "block-view", fp4_sql("block-view"))
_code_query("q_fp4_token", "fp4_native", "token-layer", fp4_sql("token-layer").replace("AS code,", "AS mono,").replace("AS native,", "AS code,"))
_code_query("q_int8", "int8", "block-layer", int_sql("block-layer", 8))
_code_query("q_intn", "int4", "block-layer", int_sql("block-layer", 4))
_code_query("q_int3", "int3", "gop", int_sql("gop", 3))


@query(
    "q_int2",
    f"WITH {CELLS}, p AS (SELECT *, max(abs(v)) OVER (PARTITION BY layer, token, head, channel // 8) AS amax FROM cells), s AS (SELECT *, {scale_sql('amax', 2.0)} AS scale FROM p), "
    "q AS (SELECT *, greatest(-2.0, least(1.0, round_even(v / scale, 0))) AS q FROM s) SELECT layer, token, head, channel, (q + 2)::INTEGER AS code, round(q * scale, 9) AS restored FROM q",
)
def q_int2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scale for each 8 consecutive channels, by projection alone."""
    vecs = vectors.kv_vectors(spark, sf_dir).withColumn("peaks", scales.group_amax(F.col("vec"), 8))
    cells = vecs.select("layer", "token", "head", "peaks", F.posexplode("vec").alias("channel", "v"))
    from kelpie.functions.numeric import amax_scale

    scale = amax_scale(F.get("peaks", F.floor(F.col("channel") / 8).cast("int")), 2.0)
    code, restored = Q.int2(F.col("v"), F.col("scale"))
    return cells.withColumn("scale", scale).select("layer", "token", "head", F.col("channel").cast("long").alias("channel"), code.alias("code"), F.round(restored, 9).alias("restored"))


def _lloyd(name: str, levels: list[float], bounds: list[float], partition: str, of_row: bool) -> None:
    sql = (
        f"WITH {CELLS}, p AS (SELECT *, sqrt(avg(v * v) OVER (PARTITION BY {partition})) AS rms FROM cells), s AS (SELECT *, CASE WHEN rms > 0 THEN {bf16_sql('rms')} ELSE 1.0 END AS scale FROM p), "
        f"c AS (SELECT *, {below_sql('v / scale', bounds)} AS code FROM s) SELECT layer, token, head, channel, code::INTEGER AS code, {pick_sql(levels, 'code')} * scale AS restored FROM c"
    )

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        vecs = vectors.kv_vectors(spark, sf_dir)
        if of_row:
            vecs = vecs.withColumn("scale", scales.rms_scale_of_row(F.col("vec")))
        else:
            vecs = vecs.join(scales.rms_scales(vectors.rows(spark, sf_dir), ["layer", "block"]).drop("rms"), ["layer", "block"])
        cells = vecs.select("layer", "token", "head", "scale", F.posexplode("vec").alias("channel", "v"))
        code, restored = Q.lloyd_max(levels, bounds)(F.col("v"), F.col("scale"))
        return cells.select("layer", "token", "head", F.col("channel").cast("long").alias("channel"), code.alias("code"), restored.alias("restored"))


_lloyd("q_lm2", Q.LM2_LEVELS, Q.LM2_BOUNDS, "layer, token, head", True)
_lloyd("q_lm4", Q.LM4_LEVELS, Q.LM4_BOUNDS, "layer, block", False)
_lloyd("q_lm4_vector", Q.LM4_LEVELS, Q.LM4_BOUNDS, "layer, token, head", True)


def _signed_bf16_sql(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN -{bf16_sql(f'(-({x}))')} WHEN {x} > 0 THEN {bf16_sql(f'({x})')} ELSE 0.0 END)"


def _affine(bits: int) -> None:
    top = (1 << bits) - 1
    sql = (
        f"WITH {CELLS}, p AS (SELECT *, {_signed_bf16_sql('min(v) OVER w')} AS low, max(v) OVER w AS high FROM cells WINDOW w AS (PARTITION BY layer, token)), "
        f"s AS (SELECT *, CASE WHEN high > low THEN {bf16_sql(f'((high - low) / {top}.0)')} ELSE 1.0 END AS scale FROM p), q AS (SELECT *, greatest(0.0, least({top}.0, round_even((v - low) / scale, 0))) AS q FROM s) "
        "SELECT layer, token, head, channel, q::INTEGER AS code, round(q * scale + low, 9) AS restored FROM q"
    )

    @query(f"q_affine{bits}", sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        low = F.array_min("row")
        rows = vectors.rows(spark, sf_dir).withColumn("low", F.when(low < 0, -bf16(-low)).otherwise(bf16(low))).withColumn("high", F.array_max("row"))
        span = F.col("high") - F.col("low")
        rows = rows.withColumn("scale", F.when(span > 0, bf16(F.greatest(span, F.lit(1e-300)) / F.lit(float(top)))).otherwise(F.lit(1.0)))
        code, restored = Q.affine(F.col("v"), F.col("low"), F.col("scale"), bits)
        return vectors.explode_cells(rows).withColumn("code", code).select(*CODED, F.round(restored, 9).alias("restored"))


for _bits in (4, 2):
    _affine(_bits)

_A = "least(abs(v), 448.0)"
_E = f"greatest(CASE WHEN {_A} > 0 THEN {exp_sql(f'greatest({_A}, pow(2.0, -60))')} ELSE -6.0 END, -6.0)"
E4M3 = f"""e4 AS (SELECT *, sign(v) * round_even({_A} / pow(2.0, {_E} - 3), 0) * pow(2.0, {_E} - 3) AS restored FROM cells),
e5 AS (SELECT *, abs(restored) AS m, greatest(CASE WHEN abs(restored) > 0 THEN {exp_sql("greatest(abs(restored), pow(2.0, -60))")} ELSE -6.0 END, -6.0) AS e FROM e4),
e6 AS (SELECT *, (m / pow(2.0, e - 3))::INTEGER AS u FROM e5),
coded AS (SELECT *, CASE WHEN u >= 8 THEN (e + 7)::INTEGER * 8 + u - 8 ELSE u END + CASE WHEN restored < 0 THEN 128 ELSE 0 END AS code FROM e6)"""


@query("q_fp8", f"WITH {CELLS}, {E4M3} SELECT layer, token, head, channel, code::INTEGER AS code, round(restored, 9) + 0.0 AS restored FROM coded")
def q_fp8(spark: SparkSession, sf_dir: str) -> DataFrame:
    code, restored = Q.fp8(F.col("v"))
    return vectors.kv_cells(spark, sf_dir).select("layer", "token", "head", "channel", code.alias("code"), (F.round(restored, 9) + 0.0).alias("restored"))


@query(
    "q_int8_view",
    f"""WITH {CELLS}, s AS (SELECT *, greatest(sqrt(12.0::DOUBLE) * 0.0267 * sqrt(avg(v * v) OVER w), max(abs(v)) OVER w / 127.0) AS target FROM cells WINDOW w AS (PARTITION BY token // 256, view)),
t AS (SELECT *, CASE WHEN target > 0 THEN {bf16_sql("target", True)} ELSE 1.0 END AS scale FROM s)
SELECT layer, token, head, channel, (round_even(v / scale, 0) + 128)::INTEGER AS code, round(round_even(v / scale, 0) * scale, 9) + 0.0 AS restored FROM t""",
)
def q_int8_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = vectors.kv_vectors(spark, sf_dir).withColumn("obj", F.floor(F.col("token") / 256).cast("long"))
    scaled = vecs.join(scales.view_scales_up(vecs, ["obj", "view"], 0.0267).select("obj", "view", "scale"), ["obj", "view"])
    cells = scaled.select("layer", "token", "head", "scale", F.posexplode("vec").alias("channel", "v"))
    code, restored = Q.int8_unclipped(F.col("v"), F.col("scale"))
    return cells.select("layer", "token", "head", F.col("channel").cast("long").alias("channel"), code.alias("code"), (F.round(restored, 9) + 0.0).alias("restored"))


def _map_sql(deadzone: int, step: int) -> str:
    return f"""lv AS (SELECT range - 128 AS level FROM range(256)),
fd AS (SELECT level, (sign(level) * floor(greatest(abs(level) - {deadzone}, 0) / {float(step)}))::BIGINT AS folded FROM lv),
mp AS (SELECT level + 128 AS code, dense_rank() OVER (ORDER BY folded) - 1 AS compact, avg(level) OVER (PARTITION BY folded) AS centroid FROM fd)"""


MAP_SQL = _map_sql(4, 8)


def deadzone_map(spark: SparkSession, deadzone: int, step: int) -> DataFrame:
    """(code, compact, centroid) of all 256 codes."""
    from pyspark.sql.window import Window

    level = F.col("id") - 128
    folded = (F.signum(level.cast("double")) * F.floor(F.greatest(F.abs(level) - deadzone, F.lit(0)) / step)).cast("long")
    levels = spark.range(256).select(level.alias("level"), folded.alias("folded"))
    return levels.select((F.col("level") + 128).cast("int").alias("code"), (F.dense_rank().over(Window.orderBy("folded")) - 1).cast("int").alias("compact"), F.avg("level").over(Window.partitionBy("folded")).alias("centroid"))


@query("q_int8_deadzone", f"WITH {int_sql('block-layer', 8)}, {MAP_SQL} SELECT layer, token, head, channel, compact::INTEGER AS code, round(centroid * scale, 9) AS restored FROM coded JOIN mp USING (code)")
def q_int8_deadzone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map has 256 rows and is broadcast."""
    cells = coded_cells(spark, sf_dir, "int8").join(F.broadcast(deadzone_map(spark, 4, 8)), "code")
    return cells.select("layer", "token", "head", "channel", F.col("compact").alias("code"), F.round(F.col("centroid") * F.col("scale"), 9).alias("restored"))


@query("deadzone_identity", f"WITH {_map_sql(0, 1)} SELECT count(*) AS n_codes, bool_and(abs(centroid - (code - 128)) < 1e-5) AS lossless FROM mp")
def deadzone_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a dead zone and with step 1 the map loses nothing."""
    return deadzone_map(spark, 0, 1).agg(F.count(F.lit(1)).alias("n_codes"), F.min((F.abs(F.col("centroid") - (F.col("code") - 128)) < 1e-5).cast("int")).cast("boolean").alias("lossless"))


@query(
    "scale_counts",
    "SELECT g AS granularity, CASE g WHEN 'token-layer' THEN l * t WHEN 'block-layer' THEN l * b WHEN 'block-view' THEN l * b * 4 ELSE b END AS scale_count, 2 * CASE g WHEN 'token-layer' THEN l * t WHEN 'block-layer' THEN l * b WHEN 'block-view' THEN l * b * 4 ELSE b END AS scale_bytes "
    "FROM (SELECT count(DISTINCT vec_id % 4) AS l, max(vec_id // 4) + 1 AS t, (max(vec_id // 4) + 32) // 32 AS b FROM embeddings) CROSS JOIN (VALUES ('token-layer'), ('block-layer'), ('block-view'), ('gop')) v(g)",
)
def scale_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = vectors.rows(spark, sf_dir).agg(F.countDistinct("layer").alias("l"), (F.max("token") + 1).alias("t"), F.floor((F.max("token") + 32) / 32).cast("long").alias("b"))
    count = F.create_map(F.lit("token-layer"), F.col("l") * F.col("t"), F.lit("block-layer"), F.col("l") * F.col("b"), F.lit("block-view"), F.col("l") * F.col("b") * 4, F.lit("gop"), F.col("b"))
    return shape.select(F.explode(count).alias("granularity", "scale_count")).withColumn("scale_bytes", F.col("scale_count") * 2)


ARMS = " UNION ALL ".join(f"SELECT '{name}' AS arm, v, code, restored FROM ({sql})" for name, sql in (("fp4", f"WITH {fp4_sql('block-layer')} SELECT v, code::INTEGER AS code, restored FROM coded"), ("int4", f"WITH {int_sql('block-layer', 4)} SELECT v, code, restored FROM coded"), ("int8", f"WITH {int_sql('block-layer', 8)} SELECT v, code, restored FROM coded")))


_ARM_SUMS = "count(*) AS n_values, round(sum((restored - v) * (restored - v)), 6) AS error_square, round(sum(v * v), 6) AS reference_square, round(sum((restored - v) * (restored - v)) / greatest(sum(v * v), 1e-30), 9) AS nmse, round(sqrt(sum((restored - v) * (restored - v)) / count(*)), 9) AS rmse"


def _arm_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    arms = [coded_cells(spark, sf_dir, n).select(F.lit(n).alias("arm"), "v", "code", "restored") for n in ("fp4", "int4", "int8")]
    return arms[0].unionByName(arms[1]).unionByName(arms[2])


@query("nmse_by_arm", f"SELECT arm, {_ARM_SUMS} FROM ({ARMS}) GROUP BY arm")
def nmse_by_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = distortion(_arm_cells(spark, sf_dir), ["arm"])
    return out.select("arm", "n_values", r6("error_square").alias("error_square"), r6("reference_square").alias("reference_square"), F.round(F.col("error_square") / F.greatest("reference_square", F.lit(1e-30)), 9).alias("nmse"), F.round(F.sqrt(F.col("error_square") / F.col("n_values")), 9).alias("rmse"))


@query("arm_code_histogram", f"SELECT arm, code, count(*) AS n FROM ({ARMS}) GROUP BY 1, 2")
def arm_code_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arm_cells(spark, sf_dir).groupBy("arm", F.col("code").cast("int").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("fp8_epsilon", f"WITH {CELLS}, {E4M3} SELECT round(sqrt(sum((restored - v) * (restored - v)) / sum(v * v)), 9) AS epsilon FROM coded WHERE token % 4 = 0")
def fp8_epsilon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the calibration split."""
    restored = Q.fp8(F.col("v"))[1]
    cells = vectors.kv_cells(spark, sf_dir).filter("token % 4 = 0").select("v", restored.alias("restored"))
    return distortion(cells, []).select(F.round(F.sqrt(F.col("error_square") / F.col("reference_square")), 9).alias("epsilon"))


@query("amax_over_rms", f"WITH {CELLS} SELECT layer, token, round(max(abs(v)) / greatest(sqrt(avg(v * v)), 1e-12), 6) AS amax_over_rms FROM cells GROUP BY 1, 2")
def amax_over_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kelpie.functions.numeric import amax

    rms = F.sqrt(scales.square_sum(F.col("row")) / F.size("row"))
    return vectors.rows(spark, sf_dir).select("layer", "token", r6(amax(F.col("row")) / F.greatest(rms, F.lit(1e-12))).alias("amax_over_rms"))


