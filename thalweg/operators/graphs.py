"""Connected components of an edge table whose nodes are of any type with an order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node reachable) of every node of an edge between different nodes.

    Edges are turned into stars around least nodes: in a large-star step every node sends its larger neighbours to its
    least one, in a small-star step its smaller ones, until nothing changes. Neighbours are aggregated, never collected.
    """
    links = cut(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo").distinct(), "edges")
    mark = None
    while (now := links.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.xxhash64("lo", "hi") % 1_000_003)).first()) != mark:
        mark = now
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = cut(both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct(), "large-star")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo"))
        links = cut(small.filter("hi <> lo").distinct(), "small-star")
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
