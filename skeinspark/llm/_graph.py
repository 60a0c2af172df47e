"""Connected components by alternating large and small stars; edges and labels stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stage


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """For edges (u, v) of longs: every node with an edge and its label, the smallest node it reaches.

    Neighbour lists are never gathered: each star is a minimum for each node and a join.
    """
    now = stage(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # u is above v in all of these; the small star keeps the least of each node and links the others to it.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage(low.select("u", F.col("m").alias("v")).unionByName(small).filter("u != v").distinct(), "edges")
        if (after := _state(now)) == state:
            break
        state = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return stage(labels.unionByName(roots), "components")
