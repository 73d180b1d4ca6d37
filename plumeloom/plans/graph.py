"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumeloom.plans.storage import dropped, shuffled, written


def components(links: DataFrame) -> DataFrame:
    """links (a, b: long) -> (node, root): each linked node and the least node it reaches.

    A large star hangs every larger neighbour of a node on the least node it knows, a small star
    does so for the smaller neighbours; a few rounds leave one star per component. A node's
    neighbours are never gathered: the least one is an aggregate with partial sums on the map
    side, joined back. Each round is a written table; the driver holds one checksum.
    No link, no row. Links of a node to itself are ignored.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges, seen = written(edges, "links"), None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(shuffled(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        other = large.join(shuffled(least), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, edges = edges, written(least.withColumnRenamed("m", "v").unionByName(other).distinct(), "small-star")
        dropped(before, large)
