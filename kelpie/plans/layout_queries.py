"""Code maps, packing, layouts, packets, matrices and compressed sizes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.functions import codes as C
from kelpie.functions.numeric import unit
from kelpie.operators import matrices, packets, packing
from kelpie.plans.base import CELLS, VECS, bf16_sql, exp_sql, fp4_sql, int_sql, query, r6
from kelpie.plans.codes import coded_cells
from kelpie.plans.scale_queries import E4M3
from kelpie.sources import manifests, vectors

FP4, INT8 = fp4_sql("block-layer"), int_sql("block-layer", 8)
PLACE = ["layer", "token", "head", "channel"]
FP8_SQL = f"WITH {CELLS}, {E4M3}, b AS (SELECT layer, token, head, channel, code::INTEGER AS code FROM coded)"


def _fp8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from kelpie.functions.quantizers import fp8

    return vectors.kv_cells(spark, sf_dir).select(*PLACE, fp8(F.col("v"))[0].alias("code"))


@query("fp8_mono", f"{FP8_SQL} SELECT layer, token, head, channel, code, CASE WHEN code >= 128 THEN xor(code, 255) ELSE xor(code, 128) END AS mono, code AS decoded FROM b")
def fp8_mono(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fp8(spark, sf_dir).withColumn("mono", C.fp8_mono_encode(F.col("code"))).withColumn("decoded", C.fp8_mono_decode(F.col("mono")))


@query("e4m3_split_join", f"{FP8_SQL} SELECT layer, token, head, channel, ((code >> 7) << 3) | (code & 7) AS sign_mantissa, (code >> 3) & 15 AS exponent, code >> 4 AS high, code & 15 AS low, code AS joined, code AS nibbles_joined FROM b")
def e4m3_split_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("code")
    out = _fp8(spark, sf_dir).select(*PLACE, C.e4m3_sign_mantissa(code).alias("sign_mantissa"), C.e4m3_exponent(code).alias("exponent"), C.high(code).alias("high"), C.low(code).alias("low"))
    return out.withColumn("joined", C.e4m3_join(F.col("sign_mantissa"), F.col("exponent"))).withColumn("nibbles_joined", C.nibbles_join(F.col("high"), F.col("low")))


@query("high4_mono", f"{FP8_SQL} SELECT layer, high, CASE WHEN high >= 8 THEN xor(high, 15) ELSE xor(high, 8) END AS mono, high AS decoded, count(*) AS n FROM (SELECT layer, code >> 4 AS high FROM b) GROUP BY 1, 2")
def high4_mono(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _fp8(spark, sf_dir).groupBy("layer", C.high(F.col("code")).alias("high")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("mono", C.high4_mono_encode(F.col("high"))).withColumn("decoded", C.high4_mono_decode(F.col("mono"))).select("layer", "high", "mono", "decoded", "n")


@query("sm_gray", f"{FP8_SQL} SELECT layer, sm, CASE WHEN sm >= 8 THEN 7 - (sm & 7) ELSE 8 + (sm & 7) END << 4 AS gray, sm AS decoded, count(*) AS n FROM (SELECT layer, ((code >> 7) << 3) | (code & 7) AS sm FROM b) GROUP BY 1, 2")
def sm_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _fp8(spark, sf_dir).groupBy("layer", C.e4m3_sign_mantissa(F.col("code")).alias("sm")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("gray", C.sm_to_gray(F.col("sm"))).withColumn("decoded", C.gray_to_sm(F.col("gray"))).select("layer", "sm", "gray", "decoded", "n")


@query("fp8_permute", f"{FP8_SQL} SELECT code, (code * 167 + 13) % 256 AS permuted, code AS restored, count(*) AS n FROM b GROUP BY 1")
def fp8_permute(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _fp8(spark, sf_dir).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("permuted", C.permute(F.col("code"))).withColumn("restored", C.unpermute(F.col("permuted"))).select("code", "permuted", "restored", "n")


@query(
    "bitplane",
    f"""{FP8_SQL}, bits AS (SELECT layer, token, head, channel, p, (code >> p) & 1 AS bit FROM b, (SELECT unnest(range(8))::INTEGER AS p))
SELECT layer, token, head, (p * 2 + channel // 8)::BIGINT AS place, sum(bit << (channel % 8)::INTEGER)::INTEGER AS packed FROM bits GROUP BY layer, token, head, p, channel // 8""",
)
def bitplane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of each 16-channel row transposed in Arrow batches, without a shuffle of bits."""
    planes = packing.fp8_planes(vectors.kv_vectors(spark, sf_dir), ["layer", "token", "head"], "vec")
    return planes.select("layer", "token", "head", F.col("place").cast("long").alias("place"), "packed")


@query("nibble_split", f"WITH {INT8} SELECT layer, token, head, channel, code >> 4 AS high, code & 15 AS low, code AS joined FROM coded")
def nibble_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = coded_cells(spark, sf_dir, "int8").select(*PLACE, C.high(F.col("code")).alias("high"), C.low(F.col("code")).alias("low"))
    return cells.withColumn("joined", C.nibbles_join(F.col("high"), F.col("low")))


@query("pack_nibbles", f"WITH {INT8}, s AS (SELECT view, token, channel, code & 15 AS low FROM coded) SELECT view, token, channel // 2 AS byte, sum(low << (4 * (channel % 2))::INTEGER)::BIGINT AS packed FROM s GROUP BY 1, 2, 3")
def pack_nibbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low nibbles of each row, the even one in the low half of its byte."""
    cells = coded_cells(spark, sf_dir, "int8").select("view", "token", "channel", C.low(F.col("code")).alias("code"))
    return packing.packed_bytes(cells, ["view", "token"], "channel", 4)


@query("unpack_nibbles", f"WITH {INT8} SELECT view, token, channel AS place, code & 15 AS code FROM coded")
def unpack_nibbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.unpacked_codes(pack_nibbles(spark, sf_dir), ["view", "token"], 4)


@query("nibble_bytes", "SELECT vec_id % 4 AS layer, count(*) AS n, ((count(*) + 1) // 2)::BIGINT AS nibble_bytes FROM embeddings GROUP BY 1")
def nibble_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.rows(spark, sf_dir).groupBy("layer").agg(F.count(F.lit(1)).alias("n")).withColumn("nibble_bytes", C.nibble_bytes(F.col("n")))


def _pack(bits: int, coded: str, quantizer: str) -> None:
    lanes = 8 // bits

    @query(f"pack_codes_{bits}", f"WITH {coded}, s AS (SELECT layer, token, channel * 4 + head AS place, code FROM coded) SELECT layer, token, place // {lanes} AS byte, sum((code & {(1 << bits) - 1}) << (({bits} * (place % {lanes}))::INTEGER))::BIGINT AS packed FROM s GROUP BY 1, 2, 3")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cells = coded_cells(spark, sf_dir, quantizer).select("layer", "token", (F.col("channel") * 4 + F.col("head")).alias("place"), "code")
        return packing.packed_bytes(cells, ["layer", "token"], "place", bits)


_pack(2, int_sql("block-layer", 3), "int3")
_pack(4, FP4, "fp4")
_pack(8, INT8, "int8")


@query("remap_codes", f"WITH {fp4_sql('token-layer')} SELECT layer, native::INTEGER AS native, code::INTEGER AS mono, count(*) AS n FROM coded GROUP BY 1, 2, 3")
def remap_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native E2M1 codes to monotonic ones by a table of sixteen."""
    cells = coded_cells(spark, sf_dir, "fp4_native", "token-layer")
    remap = F.array(*[F.lit(8 + c if c < 8 else 15 - c) for c in range(16)])
    return cells.groupBy("layer", F.col("code").alias("native"), F.element_at(remap, F.col("code") + 1).alias("mono")).agg(F.count(F.lit(1)).alias("n"))


@query("layout_views", f"WITH {FP4} SELECT block, view AS frame, token % 32 AS frame_row, channel AS frame_column, code::INTEGER AS code FROM coded")
def layout_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded_cells(spark, sf_dir, "fp4").select("block", F.col("view").alias("frame"), (F.col("token") % 32).alias("frame_row"), F.col("channel").alias("frame_column"), "code")


@query("layout_layer_block", f"WITH {FP4}, w AS (SELECT block FROM coded GROUP BY 1 HAVING count(DISTINCT token) = 32) SELECT block * 4 + layer AS frame, token % 32 AS frame_row, head * 16 + channel AS frame_column, code::INTEGER AS code FROM coded WHERE block IN (SELECT block FROM w)")
def layout_layer_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block-major, layer-minor frames of whole blocks."""
    whole = vectors.rows(spark, sf_dir).groupBy("block").agg(F.countDistinct("token").alias("n")).filter("n = 32").select("block")
    cells = coded_cells(spark, sf_dir, "fp4").join(whole, "block", "left_semi")
    return cells.select((F.col("block") * 4 + F.col("layer")).alias("frame"), (F.col("token") % 32).alias("frame_row"), (F.col("head") * 16 + F.col("channel")).alias("frame_column"), "code")


@query("layout_rows", f"WITH {FP4} SELECT layer, token, channel * 4 + head AS interleaved, head * 16 + channel AS concatenated, code::INTEGER AS code FROM coded")
def layout_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded_cells(spark, sf_dir, "fp4").select("layer", "token", (F.col("channel") * 4 + F.col("head")).alias("interleaved"), (F.col("head") * 16 + F.col("channel")).alias("concatenated"), "code")


VIEWS, WIDTH = vectors.LAYERS * vectors.HEADS, vectors.DIM
#: By model the padded views, the rows that views fill, and the width of a frame.
SHAPES = {m: (padded, *packing.frame_shape(m, VIEWS, WIDTH)[::2]) for m, (padded, _) in packing.GEOMETRIES.items()}
_SHAPES_SQL = "(VALUES " + ", ".join(f"('{m}', {padded}, {filled}, {full})" for m, (padded, filled, full) in SHAPES.items()) + ") g(model, padded, filled, width)"


def _int8_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(token, view, codes): block-scaled INT8 codes of each view's row, made in the row's own array."""
    from kelpie.operators.scales import with_amax_scale

    rows = with_amax_scale(vectors.rows(spark, sf_dir), "block-layer", 127.0)
    codes = rows.select("layer", "token", F.transform("row", lambda v: (F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(v / F.col("scale")))) + 128).cast("int")).alias("codes"))
    heads = F.array(*[F.struct(F.lit(h).cast("long").alias("head"), F.slice("codes", h * WIDTH + 1, WIDTH).alias("codes")) for h in range(vectors.HEADS)])
    return codes.select("layer", "token", F.explode(heads).alias("h")).select("token", (F.col("layer") * vectors.HEADS + F.col("h.head")).alias("view"), "h.codes")


def _frames(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    return packing.token_frames(_int8_rows(spark, sf_dir), model, VIEWS, WIDTH).withColumn("model", F.lit(model))


@query(
    "layout_token_frames",
    f"""WITH {INT8}, p AS (SELECT model, token // 8 AS frame, token % 8 * padded + view % filled AS frame_row, view // filled * {WIDTH} + channel AS col, code FROM coded, {_SHAPES_SQL}),
f AS (SELECT DISTINCT token // 8 AS frame FROM coded),
grid AS (SELECT model, frame, r AS frame_row, c AS col, width, padded * 8 AS height FROM f, {_SHAPES_SQL}, LATERAL (SELECT unnest(range(padded * 8)) AS r), LATERAL (SELECT unnest(range(width)) AS c))
SELECT model, frame, any_value(height)::INTEGER AS height, any_value(width)::INTEGER AS width, md5(string_agg(coalesce(code, 128)::INTEGER::VARCHAR, ',' ORDER BY frame_row, col)) AS pixels_md5
FROM grid LEFT JOIN p USING (model, frame, frame_row, col) GROUP BY 1, 2""",
)
def layout_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight tokens a frame in the three geometries: views padded to 64 (two halves side by side), 16 and 32; a digest of every frame's samples."""
    out = None
    for model in packing.GEOMETRIES:
        frames = _frames(spark, sf_dir, model).select("model", "frame", "height", "width", F.md5(F.concat_ws(",", F.col("pixels").cast("array<string>")).cast("binary")).alias("pixels_md5"))
        out = frames if out is None else out.unionByName(frames)
    return out


@query("layout_inverse", f"WITH {INT8} SELECT model, view, token, channel, code FROM coded, {_SHAPES_SQL}")
def layout_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes back from the frames of each geometry, without padded views and absent rows."""
    out = None
    for model in packing.GEOMETRIES:
        rows = packing.frame_rows(_frames(spark, sf_dir, model), model, VIEWS, WIDTH, keys=["model"])
        cells = rows.select("model", "view", "token", F.posexplode("codes").alias("channel", "code")).withColumn("channel", F.col("channel").cast("long"))
        out = cells if out is None else out.unionByName(cells)
    return out


_MONO, _HIGH = "CASE WHEN code >= 128 THEN 255 - code ELSE code + 128 END", "CASE WHEN code >> 4 >= 8 THEN 15 - (code >> 4) ELSE (code >> 4) + 8 END"


@query(
    "roundtrip_exact",
    f"""WITH {INT8}, w AS (SELECT layer, code, {_MONO} AS mono, ((code >> 7) << 3) | (code & 7) AS sm, (code >> 3) & 15 AS ex, {_HIGH} AS high, code & 15 AS low, (code * 167 + 13) % 256 AS turned FROM coded)
SELECT layer, count(*) AS n_cells, bool_and(CASE WHEN mono >= 128 THEN mono - 128 ELSE 255 - mono END = code AND ((sm >> 3) << 7) + (ex << 3) + (sm & 7) = code AND (CASE WHEN high >= 8 THEN high - 8 ELSE 15 - high END << 4) + low = code AND ((turned + 256 - 13) * {pow(167, -1, 256)}) % 256 = code) AS exact FROM w GROUP BY 1""",
)
def roundtrip_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bijections of bytes, one after the other, give back every code."""
    code = F.col("code")
    ways = [C.fp8_mono_decode(C.fp8_mono_encode(code)), C.e4m3_join(C.e4m3_sign_mantissa(code), C.e4m3_exponent(code)), C.nibbles_join(C.high(code), C.low(code)), C.unpermute(C.permute(code)), C.nibbles_join(C.high4_mono_decode(C.high4_mono_encode(C.high(code))), C.low(code))]
    same = F.lit(True)
    for w in ways:
        same = same & (w == code)
    cells = coded_cells(spark, sf_dir, "int8").select("layer", same.alias("same"))
    return cells.groupBy("layer").agg(F.count(F.lit(1)).alias("n_cells"), F.min(F.col("same").cast("int")).cast("boolean").alias("exact"))


_HALF = f"pow(2.0, greatest({exp_sql('greatest(abs(x), pow(2.0, -30))')}, -14.0) - 10)"


@query("restore", f"WITH {INT8}, r AS (SELECT layer, head, token, channel, (code - 128) * scale AS x FROM coded) SELECT layer, head, token, channel, round(sign(x) * round_even(abs(x) / {_HALF}, 0) * {_HALF}, 9) + 0.0 AS restored FROM r")
def restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes back to half-precision values."""
    from kelpie.functions.numeric import fp16

    cells = coded_cells(spark, sf_dir, "int8")
    return cells.select("layer", "head", "token", "channel", (F.round(fp16((F.col("code") - 128) * F.col("scale")), 9) + 0.0).alias("restored"))


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(format, model, obj, packet): objects of 256 tokens, their layers as groups of views, in each geometry and format, through the portable coder."""
    vecs = vectors.kv_vectors(spark, sf_dir).select(F.floor(F.col("token") / 256).cast("long").alias("obj"), F.col("layer").alias("grp"), "view", "token", "vec")
    out = None
    for model in packing.GEOMETRIES:
        for split in (False, True):
            made = packets.encoded_packets(vecs, ["obj"], model, 0.0267, packets.Deflate(), split)
            made = made.select(F.lit(packets.SPLIT if split else packets.WHOLE).alias("format"), F.lit(model).alias("model"), "obj", "packet")
            out = made if out is None else out.unionByName(made)
    return out


_FORMATS_SQL = f"(VALUES ('{packets.WHOLE}', FALSE), ('{packets.SPLIT}', TRUE)) k(format, split)"


@query(
    "packet_header",
    f"""WITH {CELLS}, s AS (SELECT token // 256 AS obj, view, sqrt(12.0::DOUBLE) * 0.0267 * sqrt(avg(v * v)) AS error, max(abs(v)) / 127.0 AS floor_ FROM cells GROUP BY 1, 2),
o AS (SELECT obj, count(*)::INTEGER AS views, sum((floor_ >= error)::INTEGER)::INTEGER AS floors FROM s GROUP BY 1), t AS (SELECT token // 256 AS obj, count(DISTINCT token)::INTEGER AS tokens FROM cells GROUP BY 1)
SELECT format, model, obj, ((tokens + 7) // 8)::INTEGER AS frames, (padded * 8)::INTEGER AS height, width::INTEGER AS width, views, tokens, 8 AS tokens_per_frame, floors AS range_floor_views, (2 * views)::BIGINT AS scale_bytes,
       CASE WHEN split THEN (views * tokens * {WIDTH} + 1) // 2 ELSE 0 END::BIGINT AS low_bytes, TRUE AS has_payload
FROM o JOIN t USING (obj), {_SHAPES_SQL}, {_FORMATS_SQL}""",
)
def packet_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of both formats and all geometries, parsed by columns."""
    out = manifests.parse_packet(_packets(spark, sf_dir))
    fields = [F.col(f"header.{c}").alias(c) for c in ("frames", "height", "width", "views", "tokens", "tokens_per_frame", "range_floor_views")]
    return out.select("format", "model", "obj", *fields, F.octet_length("scales").cast("long").alias("scale_bytes"), F.octet_length("low").cast("long").alias("low_bytes"), (F.octet_length("payload") > 0).alias("has_payload"))


@query(
    "packet_round_trip",
    f"""WITH {CELLS}, s AS (SELECT *, greatest(sqrt(12.0::DOUBLE) * 0.0267 * sqrt(avg(v * v) OVER w), max(abs(v)) OVER w / 127.0) AS target FROM cells WINDOW w AS (PARTITION BY token // 256, view)),
t AS (SELECT *, CASE WHEN target > 0 THEN {bf16_sql("target", True)} ELSE 1.0 END AS scale FROM s)
SELECT format, model, obj, view, round(any_value(scale), 9) AS scale, md5(string_agg((round_even(v / scale, 0) + 128)::INTEGER::VARCHAR, ',' ORDER BY token, channel)) AS codes_md5
FROM (SELECT *, token // 256 AS obj FROM t), (SELECT model FROM {_SHAPES_SQL}) m, {_FORMATS_SQL} GROUP BY 1, 2, 3, 4""",
)
def packet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes and scales that come back from packets of both formats and all geometries."""
    rows = packets.decoded_packets(_packets(spark, sf_dir), ["format", "model", "obj"], packets.Deflate())
    joined = rows.groupBy("format", "model", "obj", "view").agg(F.min("scale").alias("scale"), F.sort_array(F.collect_list(F.struct("token", "codes"))).alias("rows"))  # the tokens of one object
    text = F.concat_ws(",", F.flatten(F.transform("rows", lambda r: r["codes"].cast("array<string>"))))
    return joined.select("format", "model", "obj", "view", F.round("scale", 9).alias("scale"), F.md5(text.cast("binary")).alias("codes_md5"))


UNIT_CELLS = f"""{CELLS}, mu AS (SELECT *, v - avg(v) OVER (PARTITION BY view, channel) AS c FROM cells), un AS (SELECT *, c / greatest(sqrt(sum(c * c) OVER (PARTITION BY view, token)), 1e-8) AS u FROM mu)"""


def _unit_centered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, view, token, vec): unit rows of centered vectors; two groups of neighbouring layers."""
    vecs = vectors.kv_vectors(spark, sf_dir)
    means = vecs.groupBy("view").agg(F.array(*[F.avg(F.col("vec")[i]) for i in range(vectors.DIM)]).alias("mean"))
    centered = vecs.join(F.broadcast(means), "view").select(F.floor(F.col("layer") / 2).cast("long").alias("grp"), "view", "token", F.zip_with("vec", "mean", lambda a, b: a - b).alias("vec"))
    return centered.withColumn("vec", unit(F.col("vec")))


def _covariances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(left, right, d, e, c, grp): views are paired within their group of layers only."""
    found = matrices.cross_covariance(_unit_centered(spark, sf_dir), ["grp", "token"], "view", "vec", vectors.DIM)
    return found.withColumn("grp", F.floor(F.col("left") / (2 * vectors.HEADS)).cast("long"))


@query("cross_cov", f'WITH {UNIT_CELLS} SELECT a.layer // 2 AS grp, a.view AS "left", b.view AS "right", a.channel::INTEGER AS d, b.channel::INTEGER AS e, round(sum(a.u * b.u), 6) + 0.0 AS c FROM un a JOIN un b ON a.token = b.token AND a.layer // 2 = b.layer // 2 GROUP BY 1, 2, 3, 4, 5')
def cross_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _covariances(spark, sf_dir).withColumn("c", F.round("c", 6) + 0.0)


@query("gpa_fit")
def gpa_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = matrices.fit_groups(_covariances(spark, sf_dir), "grp")
    return fits.select("grp", "n_views", "iterations", r6("cosine_before").alias("cosine_before"), r6("cosine_after").alias("cosine_after"))


@query("gpa_cosines")
def gpa_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrices.fit_groups(_covariances(spark, sf_dir), "grp").select("grp", r6("cosine_after").alias("pair_cosine"), r6("energy_cosine").alias("energy_cosine"))


@query(
    "gpa_start",
    f"""WITH {UNIT_CELLS}, tr AS (SELECT a.layer // 2 AS grp, a.view AS l, b.view AS r, sum(a.u * b.u) AS t FROM un a JOIN un b ON a.token = b.token AND a.channel = b.channel AND a.layer // 2 = b.layer // 2 GROUP BY 1, 2, 3),
n AS (SELECT grp, greatest(1, round_even(t, 0)) AS n FROM tr WHERE l = r QUALIFY row_number() OVER (PARTITION BY grp ORDER BY l) = 1)
SELECT p.grp, round(avg(p.t / n), 6) + 0.0 AS pair_cosine, round(avg(p.t / sqrt(greatest(el.t, 1e-8) * greatest(er.t, 1e-8))), 6) + 0.0 AS energy_cosine
FROM tr p JOIN n USING (grp) JOIN tr el ON el.l = p.l AND el.r = p.l JOIN tr er ON er.l = p.r AND er.r = p.r WHERE p.l < p.r GROUP BY 1""",
)
def gpa_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cosines of all pairs of views that a fit starts from, plain and normalized by their energies."""
    found = matrices.fit_groups(_covariances(spark, sf_dir), "grp", iterations=0)
    return found.select("grp", (r6("cosine_before") + 0.0).alias("pair_cosine"), (r6("energy_cosine") + 0.0).alias("energy_cosine"))


@query("fit_group")
def fit_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted rotations of each group, one row for each view and row of its matrix."""
    fits = matrices.fit_groups(_covariances(spark, sf_dir), "grp")
    flat = fits.select("grp", F.posexplode("rotations").alias("at", "value"))
    return flat.select("grp", F.floor(F.col("at") / 256).cast("long").alias("view_index"), F.floor(F.col("at") % 256 / 16).cast("int").alias("i"), (F.col("at") % 16).alias("j"), r6("value").alias("value"))


@query("orthogonality", "SELECT g::BIGINT AS grp, TRUE AS orthogonal FROM range(2) t(g)")
def orthogonality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrices.fit_groups(_covariances(spark, sf_dir), "grp").select("grp", (F.col("orthogonality") < 1e-6).alias("orthogonal"))


@query("path_pairs", 'SELECT place, view AS "left", lead(view) OVER (ORDER BY place) AS "right" FROM (SELECT v AS view, (v * 5 + 3) % 16 AS place FROM range(16) t(v)) QUALIFY lead(view) OVER (ORDER BY place) IS NOT NULL')
def path_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of a path of views, a row for each view at most."""
    from pyspark.sql.window import Window

    order = spark.range(16).select(F.col("id").alias("left"), ((F.col("id") * 5 + 3) % 16).alias("place"))
    return order.select("place", "left", F.lead("left").over(Window.orderBy("place")).alias("right")).filter("right is not null")


@query("hadamard", "SELECT i::INTEGER AS i, j::INTEGER AS j, CASE WHEN bit_count((i & j)::BIGINT) % 2 = 0 THEN 0.25 ELSE -0.25 END::DOUBLE AS value FROM range(16) a(i), range(16) b(j)")
def hadamard(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = spark.range(16).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("j"))
    return i.withColumn("value", F.when(F.bit_count(F.col("i").bitwiseAND(F.col("j"))) % 2 == 0, 0.25).otherwise(-0.25))


def _angles(view: int) -> np.ndarray:
    """The angles of a view's stages; view 0 has them all in steps of a tenth."""
    return np.arange(4 * 8, dtype=float).reshape(4, 8) / 10 * (1 + view / 16)


def _stage_sql(s: int) -> str:
    """Stage s as a self-join of the cells before it: a cell and its partner 2^s channels away."""
    low = f"(a.channel >> {s + 1} << {s}) | (a.channel & {(1 << s) - 1})"
    angle = f"(({s * 8} + ({low})) / 10.0::DOUBLE * (1 + a.view / 16.0::DOUBLE))"
    return f"s{s + 1} AS (SELECT a.view, a.token, a.channel, cos({angle}) * a.v + CASE WHEN (a.channel >> {s}) & 1 = 0 THEN 1 ELSE -1 END * sin({angle}) * b.v AS v FROM s{s} a JOIN s{s} b ON a.view = b.view AND a.token = b.token AND b.channel = xor(a.channel, {1 << s}::BIGINT))"


@query("butterfly", f"WITH {CELLS}, s0 AS (SELECT view, token, channel, v FROM cells), {', '.join(_stage_sql(s) for s in range(4))} SELECT view, token, channel::INTEGER AS channel, round(v, 6) + 0.0 AS value FROM s4")
def butterfly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plane rotations of every vector by its view's angles, as one matrix a view."""
    factors = {v: matrices.butterfly_factor(_angles(v)) for v in range(VIEWS)}
    turned = matrices.rotate_large(vectors.kv_vectors(spark, sf_dir).select("view", "token", "vec"), factors)
    return turned.select("view", "token", F.posexplode("vec").alias("channel", "v")).select("view", "token", "channel", (r6("v") + 0.0).alias("value"))


@query("cayley")
def cayley(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector turned by the Cayley factor of its view; view 0 stays as it is."""
    base = np.sin(np.arange(256, dtype=float)).reshape(16, 16) / 8
    factors = {v: matrices.cayley(base * (v > 0) * (1 + v / 16)) for v in range(16)}
    turned = matrices.rotate_large(vectors.kv_vectors(spark, sf_dir).select("view", "token", "vec"), factors)
    return turned.select("view", "token", F.posexplode("vec").alias("channel", "v")).select("view", "token", "channel", r6("v").alias("value"))


#: Tokens that a stream of one compressor holds, so that no task gets a whole table.
STREAM_TOKENS = 65_536


def zip_streams(spark: SparkSession, sf_dir: str, max_tokens: int = 0) -> DataFrame:
    """(stream, raw_bytes, zip_bytes, layers, tokens): packed FP4 codes channel by channel with the heads side by side, a stream for each layer and one of all layers by token.

    A compressor's state is carried over STREAM_TOKENS tokens. With max_tokens only the tokens below it count, as in a report over a capped number.
    """
    from kelpie.functions.quantizers import fp4_native
    from kelpie.operators.scales import with_amax_scale

    rows = with_amax_scale(vectors.rows(spark, sf_dir), "token-layer", 6.0)
    rows = rows.filter(F.col("token") < max_tokens) if max_tokens else rows
    interleaved = F.array(*[F.col("row")[h * vectors.DIM + c] for c in range(vectors.DIM) for h in range(vectors.HEADS)])
    codes = rows.select("layer", "token", F.floor(F.col("token") / STREAM_TOKENS).cast("long").alias("part"), F.transform(interleaved, lambda v: fp4_native(v, F.col("scale"))[0]).alias("codes"))
    layers = packing.deflate_sizes(codes.select(F.concat(F.lit("layer-"), F.col("layer").cast("string")).alias("stream"), "part", "token", "layer", "codes"), ["stream", "part"], ["token"], "codes", 4)
    whole = packing.deflate_sizes(codes.withColumn("stream", F.lit("token-interleaved")).select("stream", "part", "token", "layer", "codes"), ["stream", "part"], ["token", "layer"], "codes", 4)
    sums = layers.unionByName(whole).groupBy("stream").agg(F.sum("raw_bytes").alias("raw_bytes"), F.sum("zip_bytes").alias("zip_bytes"))
    held = codes.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("layer").alias("layers"))
    token_layers = F.when(F.col("stream") == "token-interleaved", F.col("n")).otherwise(F.col("n") / F.col("layers"))
    return sums.crossJoin(F.broadcast(held)).withColumn("token_layers", token_layers.cast("long")).drop("n", "layers")


@query("zip_proxy")
def zip_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DEFLATE sizes of packed FP4 codes; scales stored raw."""
    out, metadata = zip_streams(spark, sf_dir), F.col("token_layers") * 2
    return out.select("stream", "raw_bytes", "zip_bytes", metadata.alias("metadata_bytes"), r6((F.col("zip_bytes") + metadata) * 8 / (F.col("token_layers") * 64)).alias("bits_per_value"))


@query("zip_inputs", f"WITH {fp4_sql('token-layer')}, b AS (SELECT layer, token, (channel * 4 + head) // 2 AS byte, sum(native::INTEGER << (4 * ((channel * 4 + head) % 2))::INTEGER) AS packed FROM coded GROUP BY 1, 2, 3) SELECT 'layer-' || layer AS stream, token, md5(string_agg(packed::VARCHAR, ',' ORDER BY byte)) AS bytes_md5 FROM b GROUP BY layer, token")
def zip_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the compressor of zip_proxy() is fed, row by row."""
    cells = coded_cells(spark, sf_dir, "fp4_native", "token-layer").select("layer", "token", (F.col("channel") * 4 + F.col("head")).alias("place"), "code")
    rows = packing.packed_bytes(cells, ["layer", "token"], "place", 4).groupBy("layer", "token").agg(F.sort_array(F.collect_list(F.struct("byte", "packed"))).alias("b"))
    return rows.select(F.concat(F.lit("layer-"), F.col("layer").cast("string")).alias("stream"), "token", F.md5(F.concat_ws(",", F.transform("b", lambda x: x["packed"].cast("string"))).cast("binary")).alias("bytes_md5"))


@query("energy_of_moments", f"WITH {VECS} SELECT layer, head, count(*) AS n, round(sum(list_sum(list_transform(vec, lambda x: x * x))), 6) AS trace FROM vecs GROUP BY 1, 2")
def energy_of_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace of each view's second moment."""
    from kelpie.operators.scales import square_sum

    return vectors.kv_vectors(spark, sf_dir).groupBy("layer", "head").agg(F.count(F.lit(1)).alias("n"), r6(F.sum(square_sum(F.col("vec")))).alias("trace"))


_QK = f"""WITH {FP4}, q AS (SELECT a.layer, a.head, a.block, a.channel AS d, b.channel AS e, avg(a.v * b.v) AS cov, count(*) AS n, sum((a.restored - a.v) * (b.restored - b.v)) AS ee, sum(a.v * b.v) AS vv
  FROM coded a JOIN coded b ON a.layer = b.layer AND a.head = b.head AND a.token = b.token GROUP BY 1, 2, 3, 4, 5)
SELECT layer, head, round(sum(ee * cov * n), 9) AS qk_error, round(sum(vv * cov * n), 6) AS qk_reference FROM q GROUP BY 1, 2"""


@query("qk_error", _QK)
def qk_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quadratic form of errors under each block's second moments, weighted by their counts: from Gram matrices of a block's rows, in Arrow batches."""
    from kelpie.operators.scales import with_amax_scale

    scaled = with_amax_scale(vectors.rows(spark, sf_dir), "block-layer", 6.0)
    blocks = scaled.groupBy("layer", "block").agg(F.min("scale").alias("scale"), F.collect_list("row").alias("rows"))  # a block has 32 rows
    sums = matrices.block_forms(blocks, "layer", "rows", "scale", vectors.HEADS)
    return sums.groupBy("layer", "head").agg(F.round(F.sum("error_form"), 9).alias("qk_error"), r6(F.sum("reference_form")).alias("qk_reference"))
