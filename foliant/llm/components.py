"""Connected components of an edge table: alternating large and small stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, of every node in an edge. Nothing goes to the driver but counts.

    A star is kept as (node, head) with head < node. Each round links every head's neighbours to the smallest of them
    (partial minima first, so a hot head is no hot task), until no link changes; an error if that takes more than `rounds`, as components would come back split.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    links = stored(links)
    before = None
    for _ in range(rounds):
        # large star: every neighbour above u goes to the least neighbour of u
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the neighbours below u, and u itself, go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    return links.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
