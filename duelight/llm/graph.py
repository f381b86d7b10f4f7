"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelight.llm.tables import discard, materialise


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Join each node's larger (or smaller) neighbours to the least node that it knows of."""
    both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = both.where("v > u") if large else both
    out = moved.join(least, "u").select(F.col("v"), F.col("m"))
    if not large:
        out = out.union(least.select(F.col("u").alias("v"), F.col("m")))
    return out.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component of every node in (a, b): the least node that links reach.

    Each round rewrites the edges as stars around ever smaller nodes; their number
    never grows, rounds grow with the logarithm of a component's size, and each one
    starts from a written table. Converged when a round changes no edge.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    pairs = materialise(pairs, name)
    seen = None
    while True:
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select(F.col("v"), F.col("v")).distinct())
        seen = state
        before, pairs = pairs, materialise(_star(_star(pairs, large=True), large=False), name)
        discard(before)
