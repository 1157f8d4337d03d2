"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def _minimum(directed: DataFrame) -> DataFrame:
    return directed.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges``: distinct links (u, v), u != v, ids of any ordered type.

    Returns (node, component) for every node with a link; component is the smallest node
    reachable. Each round links every node's larger neighbours to its smallest neighbour
    (large star), then its smaller ones (small star); the link table shrinks to one star
    per component in O(log^2 n) rounds. Every round is written to the shared folder, so a
    lost executor costs one round at most.
    """
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    before = _signature(now)
    if not before[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(_minimum(both).withColumn("m", F.least("u", "m")), "u")
                 .where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where(F.col("u") != F.col("v")).distinct())
        # every link now points from the larger to the smaller node
        small = large.join(_minimum(large), "u")
        small = (small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(small.select("u", F.col("m").alias("v")))
                 .where(F.col("u") != F.col("v"))
                 .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = materialize(small, "cc")
        after = _signature(now)
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
