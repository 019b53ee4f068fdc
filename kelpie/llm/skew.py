"""A join of many rows with a table of unique keys that a few very frequent keys do not bring down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least this share of all rows is heavy; so at most its inverse, a thousand keys, are broadcast.
HEAVY = 1000


def lookup_join(rows: DataFrame, table: DataFrame, keys: list[str], count: str) -> DataFrame:
    """rows, each with the columns of its key in table; inner. table has one row for each key and in `count` the number of rows with it.

    The heavy keys, at most HEAVY by their definition, are broadcast, and their rows never shuffled; all others are joined by shuffle, sorted and so able to spill.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    bound = max(total // HEAVY, 1)
    light = table.filter(F.col(count) <= bound).drop(count)
    heavy = table.filter(F.col(count) > bound).drop(count)
    some = rows.join(F.broadcast(heavy), keys)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys)
    return rest.unionByName(some)
