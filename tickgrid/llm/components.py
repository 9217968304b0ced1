"""Connected components of a large edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickgrid.llm.common import written


def _mins(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _mins(both).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them. Needs ``u > v``."""
    low = _mins(edges)
    hooks = edges.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hooks.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` long edges -> ``(node, component)``, the component's smallest node.

    Only nodes that occur in an edge between two different nodes are returned;
    null ends, self links, repeats and either direction are allowed. Each round
    works on stars through map-side minima and joins, so a node with very many
    edges is never gathered into one group, and the number of rounds grows with
    the logarithm of the graph. Nothing but a count and a digest reaches the driver.
    """
    stars = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    stars = written(stars.filter("u > v").distinct(), "edges")
    seen = None
    while True:
        state = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(state) == seen or state[0] == 0:
            break
        seen = tuple(state)
        stars = written(_small_star(_large_star(stars)), "edges")
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
