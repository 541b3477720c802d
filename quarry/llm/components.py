"""Connected components of an edge list, by alternating star operations."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``) that has an edge to
    another node; root is the smallest node reachable.

    Large star: every larger neighbour of u is linked to u's smallest neighbour
    (or u).  Small star: u and its smaller neighbours are linked to the
    smallest.  Components are kept, and after a logarithmic number of rounds
    all edges point at the root.  A hub is reduced by partial minima and an
    equi-join that adaptive execution can split, never collected.  Each round
    is written to the checkpoint folder; the loop ends when a round changes
    nothing."""
    links = cut_lineage(edges.where("a <> b")
                        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.where("v > u").join(least, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut_lineage(small.union(low.select("u", F.col("m").alias("v"))).distinct())
