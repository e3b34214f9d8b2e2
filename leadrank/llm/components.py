"""Connected components of a large graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leadrank.session import cut_lineage


def _nearest(edges: DataFrame) -> DataFrame:
    """Each node with the smallest node next to it, and the number of its smaller and larger neighbours."""
    both = edges.union(edges.select("v", "u"))
    larger = F.count_if(F.col("v") > F.col("u"))
    return both.groupBy("u").agg(F.min("v").alias("m"), (F.count("*") - larger).alias("smaller"), larger.alias("larger"))


def _large_star(edges: DataFrame, nearest: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest node next to it; edges lead downwards, one comes of each."""
    lowest = nearest.select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
    return edges.join(lowest, "v").select("u", F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them; every edge already leads downwards."""
    lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(lowest.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """`u`, `v` per edge in; out: one row `u`, `v` for each node but the smallest of its component, `v` being that one.

    Each round writes the edges; the number of rounds grows with the logarithm of the longest path. Edges are stars, and
    done, when no node has a second smaller neighbour, or smaller and larger ones; the first step of a round tells. Minima
    combine before the shuffle and joins split hot nodes, so a hub with a third of all edges is no single task.
    """
    edges = cut_lineage(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    while True:
        nearest = cut_lineage(_nearest(edges))
        if nearest.where("smaller > 1 or smaller > 0 and larger > 0").agg(F.count("*")).first()[0] == 0:
            return edges
        edges = cut_lineage(_small_star(_large_star(edges, nearest)))
