"""Connected components of an undirected link table, by alternating large-star and small-star steps.

Every step is joins and minimums with partial aggregation, and each round's links are written to the shared folder,
so no task and not the driver ever holds a component. Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``u`` and ``v`` of one ordered type); ``root`` is its component's least node.

    Self-links, repeated links and either direction are fine. An empty table gives an empty table.
    """
    seed = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = materialise(seed, "links")
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select("u", F.least("u", "m").alias("m"))
        # every larger neighbour of u points to u's least neighbour
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = materialise(large, "links")
        # every smaller neighbour of u, and u, points to the least of them
        small = down.join(_least(down), "u").select(F.col("v"), F.col("u"), "m")
        links = materialise(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct(),
            "links",
        )
        ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))
        # stars only: each node has one link up, and no root has any
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 or up = 1 and root = 1").isEmpty():
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
