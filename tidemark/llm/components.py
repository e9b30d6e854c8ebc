"""Connected components by alternating stars, without any node's neighbours in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``node, component`` for the nodes of ``a, b`` (whole numbers): the smallest node that links reach.

    Every round hangs a node's larger neighbours, then its smaller ones, under the smallest; the rounds grow with the
    logarithm of the number of nodes. Loops count as nodes; null ends are left out; no edges, no rows.
    """
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL").select(F.col("a").cast("long"), F.col("b").cast("long"))
    alone = edges.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = None
    for _ in range(most_rounds):
        e = checkpoint(e)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state = now
        # larger neighbours of u go under the smallest of u and its neighbours
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = e.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # u and its smaller neighbours go under the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u <> v").distinct()
    else:
        raise RuntimeError(f"components not found in {most_rounds} rounds")
    leaves = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).union(alone).groupBy("node").agg(F.min("component").alias("component"))
