"""Registration of queries, and the DuckDB text that their SQL shares."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.sources.vectors import BLOCK, DIM, HEADS, LAYERS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# DuckDB: the cells of the vector tables, and the rows and vectors they come from.
CELLS = f"""cells AS (
  SELECT vec_id % {LAYERS} AS layer, vec_id // {LAYERS} AS token, (vec_id // {LAYERS}) // {BLOCK} AS block, label,
         ((c - 1) // {DIM})::BIGINT AS head, ((c - 1) % {DIM})::BIGINT AS channel, (vec_id % {LAYERS}) * {HEADS} + (c - 1) // {DIM} AS view,
         embedding[c]::DOUBLE AS v
  FROM (SELECT *, unnest(range(1, {HEADS * DIM + 1})) AS c FROM embeddings))"""
VECS = f"""vecs AS (
  SELECT vec_id % {LAYERS} AS layer, vec_id // {LAYERS} AS token, (vec_id // {LAYERS}) // {BLOCK} AS block, label, head::BIGINT AS head,
         (vec_id % {LAYERS}) * {HEADS} + head AS view,
         list_transform(embedding[head * {DIM} + 1:head * {DIM} + {DIM}], lambda x: x::DOUBLE) AS vec
  FROM (SELECT *, unnest(range(0, {HEADS})) AS head FROM embeddings))"""


def exp_sql(x: str) -> str:
    f = f"floor(log2({x}))"
    return f"(CASE WHEN pow(2.0, {f}) > {x} THEN {f} - 1 WHEN pow(2.0, {f} + 1) <= {x} THEN {f} + 1 ELSE {f} END)"


def bf16_sql(x: str, up: bool = False) -> str:
    ulp = f"pow(2.0, {exp_sql(x)} - 7)"
    rounded = f"ceil({x} / {ulp})" if up else f"round_even({x} / {ulp}, 0)"
    return f"({rounded} * {ulp})"


def scale_sql(amax: str, divisor: float) -> str:
    return f"CASE WHEN {amax} > 0 THEN {bf16_sql(f'({amax} / {divisor})')} ELSE 1.0 END"


SCALE_KEYS = {"token-layer": "layer, token", "block-layer": "layer, block", "block-view": "layer, block, head", "gop": "block"}


def scaled_sql(granularity: str, divisor: float) -> str:
    """CTEs cells, peaks and scaled (cells with their scale)."""
    return f"""{CELLS},
peaks AS (SELECT *, max(abs(v)) OVER (PARTITION BY {SCALE_KEYS[granularity]}) AS amax FROM cells),
scaled AS (SELECT * EXCLUDE (amax), {scale_sql("amax", divisor)} AS scale FROM peaks)"""


def below_sql(x: str, bounds: list[float]) -> str:
    return "(" + " + ".join(f"({x} > {b!r}::DOUBLE)::INTEGER" for b in bounds) + ")"


def pick_sql(values: list[float], index: str) -> str:
    return f"[{', '.join(f'{v!r}::DOUBLE' for v in values)}][{index} + 1]"


def fp4_sql(granularity: str) -> str:
    """CTE coded with the monotonic and the native E2M1 code and the restored value."""
    from kelpie.functions.quantizers import E2M1_BOUNDS, E2M1_MAGNITUDES

    return f"""{scaled_sql(granularity, 6.0)},
indexed AS (SELECT *, v / scale AS x, {below_sql("abs(v / scale)", E2M1_BOUNDS)} AS i FROM scaled),
coded AS (SELECT *, CASE WHEN x < 0 THEN 7 - i ELSE 8 + i END AS code, CASE WHEN x < 0 THEN i + 8 ELSE i END AS native,
                 CASE WHEN x < 0 THEN -{pick_sql(E2M1_MAGNITUDES, "i")} ELSE {pick_sql(E2M1_MAGNITUDES, "i")} END * scale AS restored FROM indexed)"""


def int_sql(granularity: str, bits: int = 8) -> str:
    top = (1 << bits - 1) - 1
    return f"""{scaled_sql(granularity, float(top))},
leveled AS (SELECT *, greatest({-top}.0, least({top}.0, round_even(v / scale, 0))) AS q FROM scaled),
coded AS (SELECT *, (q + {top + 1})::INTEGER AS code, q * scale AS restored FROM leveled)"""
