"""Connected components by alternating large and small stars, in DataFrame operations.

Each round replaces edges by edges to smaller neighbours; rounds are written to the shared folder, so lineage stays
short and a lost executor costs one round; the round before is deleted. The number of rounds grows with the logarithm of the graph's diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """Rows (node, root): the least node of each component for every node that has an edge, itself included."""
    edges = materialise(edges.where("u <> v").select("u", "v").distinct(), f"{name}-edges")
    state = None
    while True:
        before, edges = edges, materialise(_small_star(_large_star(edges)), f"{name}-stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        # equal sums only say that it may be the end; rounds of as many distinct edges are equal if none is new
        end = tuple(now) == state and edges.join(before, ["u", "v"], "left_anti").isEmpty()
        discard(before)
        if end:
            break
        state = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
