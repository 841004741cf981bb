"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.llm.common import written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node tells its larger neighbours the smallest node that it knows."""
    pairs = _both(edges)
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node tells its smaller neighbours, and itself, the smallest of them."""
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    told = pairs.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return told.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (u, v) of long -> (node, component): the smallest node that each node of an edge reaches.

    Loops (u = v), repeated edges and edges with a null are ignored; an empty table gives an empty one. Every round is
    written to the shared folder. A hub's edges are joined with one row of minima, so that Spark may split the hub.
    """
    now = written(edges.select("u", "v").where("u <> v").distinct(), "edges")
    measure = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = measure(now)
    for _ in range(max_rounds):
        now = written(_small_star(_large_star(now)), "star")
        after = measure(now)
        if after == before:
            least = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return least.union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        before = after
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
