"""Connected components by alternating large-star and small-star rounds, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpie.llm.common import discard, materialize
from kelpie.llm.skew import lookup_join

#: Rounds grow with the logarithm of the longest chain; this many means that the rounds do not settle.
MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs the larger (large) or the smaller neighbours of every node, with itself, on the least of its neighbours. Nodes with very many neighbours are looked up by broadcast."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if large else edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = materialize(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"), F.count(F.lit(1)).alias("degree")), "components-least")
    hung = lookup_join(both, least, ["src"], "degree")
    if large:
        hung = hung.filter(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    else:
        hung = hung.select(F.col("dst").alias("src"), F.col("low").alias("dst")).unionByName(least.select("src", F.col("low").alias("dst")))
    hung = materialize(hung.filter(F.col("src") != F.col("dst")).distinct(), "components")
    discard(least)
    return hung


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (src, dst) between different values; root is the component's least node. No edges: no rows."""
    edges = edges.filter(F.col("src") != F.col("dst")).distinct()
    state = materialize(edges, "components")
    before = None
    for _ in range(MOST_ROUNDS):
        found = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if found[0] == 0 or found == before:
            return state.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(state.select(F.col("dst").alias("node"), F.col("dst").alias("root"))).distinct()
        before = found
        grown = _star(state, True)
        discard(state)
        state = _star(grown, False)
        discard(grown)
    raise RuntimeError("components did not settle")
