"""Differences between neighbouring codes, from arrays of a row's codes.

A row is one (layer, token) with all heads' channels. Neighbours along channels
stand in the same array; those along views or tokens are reached by one equi-join
of whole rows on (layer, token), so that the work is dealt by row and not by the
few (view, channel) lines, and cells are exploded only once they stand beside
their neighbours. A neighbour is what stands at the next place; beyond an edge,
or a gap in the tokens, there is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpie.functions.numeric import bits
from kelpie.sources.vectors import DIM, HEADS

MODES = ["left", "up", "planar", "previous"]
BIDIRECTIONAL = "bidirectional"


def _beside(rows: DataFrame, name: str, layer: int = 0, token: int = 0, codes: str = "codes") -> DataFrame:
    """Adds the codes of the row so many layers and tokens before this one; null where there is none."""
    other = rows.select((F.col("layer") + layer).alias("layer"), (F.col("token") + token).alias("token"), F.col(codes).alias(name))
    return rows.join(other, ["layer", "token"], "left")


def _nothing(count: int) -> Column:
    return F.array_repeat(F.lit(None).cast("int"), count)


def _shifted(codes: str, edge: str | None = None) -> Column:
    """Each view's codes, from the view before: of the layer before (column `edge`) for the first head."""
    first = _nothing(DIM) if edge is None else F.coalesce(F.slice(edge, (HEADS - 1) * DIM + 1, DIM), _nothing(DIM))
    return F.concat(first, F.slice(codes, 1, (HEADS - 1) * DIM))


def _left(codes: Column) -> Column:
    """The code of the channel before; null at each head's first channel."""
    return F.transform(codes, lambda x, i: F.when(i % DIM > 0, F.get(codes, i - 1)))


def with_neighbors(rows: DataFrame, axis: str, codes: str = "codes") -> DataFrame:
    """rows (layer, token, codes) with `before`: the codes next before along channel, view, token or layer, or interleaved (channel by channel, the heads side by side; codes are put in that order)."""
    if axis == "interleaved":
        mixed = rows.withColumn(codes, F.array(*[F.col(codes)[h * DIM + c] for c in range(DIM) for h in range(HEADS)]))
        return mixed.withColumn("before", F.concat(_nothing(1), F.slice(codes, 1, HEADS * DIM - 1)))
    if axis == "channel":
        return rows.withColumn("before", _left(F.col(codes)))
    if axis == "view":
        return _beside(rows, "_edge", layer=1, codes=codes).withColumn("before", _shifted(codes, "_edge")).drop("_edge")
    return _beside(rows, "before", layer=int(axis == "layer"), token=int(axis == "token"), codes=codes)


def pairs(rows: DataFrame, axis: str) -> DataFrame:
    """(code, before) of all cells of rows (layer, token, codes) that have a neighbour."""
    found = with_neighbors(rows.select("layer", "token", "codes"), axis).filter("before is not null")
    cells = found.select(F.explode(F.arrays_zip("codes", "before")).alias("c"))
    return cells.select(F.col("c.codes").alias("code"), F.col("c.before").alias("before")).filter("before is not null")


def adjacent_bits(found: DataFrame, scale: float = 16.0) -> DataFrame:
    return found.agg(F.avg(bits(F.col("code") - F.col("before"), scale)).alias("bits_per_pair"), F.count(F.lit(1)).alias("pair_count"))


def _softmin(costs: list[Column], temperature: float) -> Column:
    """-T * log(sum(exp(-c / T))), shifted by the least cost."""
    low = F.least(*costs)
    total = sum((F.exp((low - c) / F.lit(temperature)) for c in costs[1:]), F.exp((low - costs[0]) / F.lit(temperature)))
    return low - F.lit(temperature) * F.log(total)


def block_costs(rows: DataFrame, neutral: float, scale: float, height: int = 16, width: int = 16, layers: int = 0) -> DataFrame:
    """(view, by, bx, left, up, planar, previous): summed residual bits of each predictor in each block; the first view cannot use the previous one.

    With `layers`, the number of layers, also the predictor from the views on both sides, which neither the first nor the last view can use.
    """
    rows = rows.select("layer", "token", "codes")
    near = _beside(_beside(rows, "u", token=1), "_edge", layer=1)
    near = near.withColumn("l", _left(F.col("codes"))).withColumn("p", _shifted("codes", "_edge"))
    names = ["codes", "l", "u", "p"]
    if layers:
        near = _beside(near, "_after", layer=-1)
        near = near.withColumn("n", F.concat(F.slice("codes", DIM + 1, (HEADS - 1) * DIM), F.coalesce(F.slice("_after", 1, DIM), _nothing(DIM))))
        names.append("n")
    near = near.withColumn("u", F.coalesce("u", _nothing(HEADS * DIM)))
    cells = near.select("layer", "token", F.posexplode(F.arrays_zip(*names)).alias("_p", "c"))
    value = lambda n: F.coalesce(F.col(f"c.{n}").cast("double"), F.lit(float(neutral)))
    by_mode = {"left": value("l"), "up": value("u"), "planar": (value("l") + value("u")) * 0.5, "previous": value("p")}
    if layers:
        by_mode[BIDIRECTIONAL] = (value("p") + value("n")) * 0.5
    view = F.col("layer") * HEADS + F.floor(F.col("_p") / DIM)
    cost = cells.select(view.alias("view"), F.floor(F.col("token") / height).alias("by"), F.floor(F.col("_p") % DIM / width).alias("bx"), *[bits(value("codes") - x, scale).alias(n) for n, x in by_mode.items()])
    summed = cost.groupBy("view", "by", "bx").agg(*[F.sum(m).alias(m) for m in by_mode])
    never = F.lit(height * width * 32.0)
    summed = summed.withColumn("previous", F.when(F.col("view") == 0, never).otherwise(F.col("previous")))
    if layers:
        summed = summed.withColumn(BIDIRECTIONAL, F.when((F.col("view") == 0) | (F.col("view") == layers * HEADS - 1), never).otherwise(F.col(BIDIRECTIONAL)))
    return summed


def rate_proxy(rows: DataFrame, neutral: float, scale: float, temperature: float = 1.0, layers: int = 0) -> DataFrame:
    """Total, intra-only and inter-only bits for each value, and the mean probability of each mode; inter-only takes the better of its modes."""
    costs = block_costs(rows, neutral, scale, layers=layers)
    modes = MODES + [BIDIRECTIONAL] * bool(layers)
    every = [F.col(m) for m in modes]
    low = F.least(*every)
    weight = [F.exp((low - c) / F.lit(temperature)) for c in every]
    whole = sum(weight[1:], weight[0])
    inter = F.least(*every[3:]) if layers else F.col("previous")
    sums = costs.agg(F.sum(_softmin(every, temperature)).alias("t"), F.sum(_softmin(every[:3], temperature)).alias("i"), F.sum(inter).alias("p"), *[F.avg(w / whole).alias(f"p_{m}") for m, w in zip(modes, weight, strict=True)])
    n = rows.agg(F.sum(F.size("codes")).alias("n"))
    return sums.crossJoin(F.broadcast(n)).select((F.col("t") / F.col("n")).alias("total_bits"), (F.col("i") / F.col("n")).alias("intra_bits"), (F.col("p") / F.col("n")).alias("inter_bits"), *[f"p_{m}" for m in modes])
