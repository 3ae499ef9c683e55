"""Connected components of a table of links, by star contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatrisk.plans.checkpoints import checkpointed


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component) for every node of `links` (a, b); the component is its smallest node.

    Large-star and small-star steps alternate until nothing changes. A step groups by a node, and its
    minimum is combined before the shuffle; no step collects the neighbours of a node. Every round is a
    table in the shared folder. An empty table gives an empty result.
    """
    edges = checkpointed(
        links.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).filter("low < high").distinct(),
        "links",
    )
    before = None
    for _ in range(rounds):
        edges = checkpointed(_small_star(_large_star(edges)), "stars")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = edges.select(F.col("high").alias("node"), F.col("low").alias("component"))
    return nodes.unionByName(edges.select(F.col("low").alias("node"), F.col("low").alias("component"))).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it."""
    both = edges.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(
        edges.select(F.col("high").alias("u"), F.col("low").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.join(least, "u").filter(F.col("v") > F.col("u"))
        .select(F.col("m").alias("low"), F.col("v").alias("high")).filter("low < high").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node's smaller neighbours, and the node, are tied to the smallest of them."""
    least = edges.groupBy("high").agg(F.min("low").alias("m"))
    joined = edges.join(least, "high")
    tied = joined.select(F.col("m").alias("low"), F.col("low").alias("high"))
    return tied.unionByName(least.select(F.col("m").alias("low"), F.col("high"))).filter("low < high").distinct()
