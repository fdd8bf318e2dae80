"""Connected components of a table of links, without bringing links to the driver.

Large-star and small-star steps alternate (Kiveris et al., 2014): each hangs a node's neighbours on the smallest node it knows, so after
few rounds every component is a star around its smallest node. Each round is written to the shared folder, which cuts the lineage;
the driver sees a count and a checksum of the links, and stops when they no longer change. Joins are merge joins at every size, so no side is
brought to the driver to be broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import durable

MOST_ROUNDS = 100


def connected_components(links: DataFrame) -> DataFrame:
    """links: u, v (of any type with an order, not null). Gives node, component (its smallest node) of every node that has a link to another."""
    edges = durable(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    seen = None
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(smallest.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = durable(large, "large-star")
        centre = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(centre.hint("merge"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(centre.select("u", F.col("m").alias("v")))
        edges = durable(small.distinct(), "small-star")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components are not found after {MOST_ROUNDS} rounds")
    star = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.unionByName(star.select(F.col("component").alias("node"), "component").distinct())
