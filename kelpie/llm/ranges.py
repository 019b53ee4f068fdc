"""Ranges of an identifier and a tie, so that a table can be dealt out in order by a single shuffle of its rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a range, roughly; a range with so many times its share is uneven.
ROWS_EACH, UNEVEN = 32_768, 4
_PAIR = np.dtype([("key", "<i8"), ("tie", "<i8")])


def ranges_of(rows: DataFrame, least: int) -> np.ndarray:
    """The first (key, tie) of each range of rows (key, tie) in ascending order, of about ROWS_EACH rows each and `least` of them at least, if there are so many keys.

    A range begins with a key, whatever the ties, so the other columns need not
    be read; only if a single key has far more rows than a range should, ranges
    are drawn by key and tie. The driver gets a line for each range.
    """
    keys = rows.select("key")
    total = keys.count()
    ranges = max(least, -(-total // ROWS_EACH))
    part = F.spark_partition_id().alias("p")
    dealt = keys.repartitionByRange(ranges, "key").groupBy(part).agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("held")).collect()
    if any(r["low"] == r["high"] and r["held"] > max(ROWS_EACH, UNEVEN * total // ranges) for r in dealt):
        firsts = [tuple(r["first"]) for r in rows.select("key", "tie").repartitionByRange(ranges, "key", "tie").groupBy(part).agg(F.min(F.struct("key", "tie")).alias("first")).collect()]
    else:
        firsts = [(r["low"], -(1 << 63)) for r in dealt]
    return np.array(sorted(firsts), dtype=_PAIR)


def place_of(bounds: np.ndarray):
    """A function of the columns key and tie that gives the number of a row's range."""
    import pandas as pd

    @F.pandas_udf("int")
    def place(key, tie):
        return pd.Series(place_in(bounds, key.to_numpy(), tie.to_numpy()))

    def of(key: str, tie: str) -> Column:
        return place(F.col(key), F.col(tie))

    return of


def place_in(bounds: np.ndarray, key: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """The last range whose first row is not beyond (key, tie)."""
    low, high = np.searchsorted(bounds["key"], key, side="left"), np.searchsorted(bounds["key"], key, side="right")
    place = high - 1
    for i in np.flatnonzero(high > low):  # rows that share the key of one bound or more
        place[i] = low[i] + np.searchsorted(bounds["tie"][low[i] : high[i]], tie[i], side="right") - 1
    return place.astype(np.int32)
