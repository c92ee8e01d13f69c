"""Connected components of an undirected graph by alternating large-star and small-star steps.

Each step replaces every edge by at most one edge, so the edge table never grows; after O(log n)
rounds each component is a star around its smallest node. Neighbourhoods are only ever reduced with
``min``, which combines on the map side, so a node with very many neighbours is no burden.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("m").alias("u"), "v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours and the node are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").where("v <> m").select(F.col("m").alias("u"), "v")
    return linked.unionByName(least.select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("x")).first()
    return row["n"], row["h"], row["x"]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; the component is its smallest node.

    ``edges`` has columns u and v (both directions and repeats allowed, loops ignored).
    """
    stars = staged(edges.select("u", "v").where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "star")
    before = _state(stars)
    while True:
        stars = staged(_small_star(_large_star(stars)), "star")
        now = _state(stars)
        if now == before:
            break
        before = now
    return stars.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(stars.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
