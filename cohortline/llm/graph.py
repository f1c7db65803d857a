"""Connected components of a graph given as edges, as a few Spark joins per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.common import scratch


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node hangs on one smaller node, which itself hangs on none."""
    split = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("u")
    chained = edges.select(F.col("v").alias("u")).join(edges, "u", "left_semi")
    return split.unionByName(chained).isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, its smallest node, for every node of ``edges`` (columns ``u`` and ``v``, longs).

    Alternating stars: every node hands its larger neighbours to its smallest neighbour, then all its smaller ones.
    The number of edges never grows, and long chains shrink by half in each round. A hub's edges are combined before
    they are shuffled, and the smaller side of each join is written first, so adaptive execution can split a hub.
    """
    edges = scratch(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    while not _is_star_forest(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = scratch(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = both.filter("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch(large.filter("u <> v").distinct())
        smallest = scratch(large.groupBy("u").agg(F.min("v").alias("m")))
        moved = large.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = smallest.select("u", F.col("m").alias("v"))
        edges = scratch(moved.unionByName(own).filter("u <> v").distinct())
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
