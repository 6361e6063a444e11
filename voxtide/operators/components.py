"""Connected components by alternating star contractions (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtide.session import materialize


def _lowest(edges: DataFrame) -> DataFrame:
    """Smallest neighbour of each node, the node itself included."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both_ways(edges)
    lowest = materialize(_lowest(both), "lowest")
    joined = both.join(lowest, "u").where(F.col("v") > F.col("u"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = materialize(_lowest(down), "lowest")
    moved = down.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(lowest.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """(node, component) for all nodes with an edge to another node.

    A component is named by its smallest node. Hubs are never gathered in one place:
    minima are combined before the shuffle, and joins on a hub are split when skewed
    (the minima are written out, as only plain shuffles can be split).
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct()
    pairs = materialize(pairs, "edges")
    state = None
    for _ in range(max_rounds):
        pairs = materialize(_small_star(_large_star(pairs)), "edges")
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("v").alias("u")).distinct().withColumn("v", F.col("u"))
    return pairs.union(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))
