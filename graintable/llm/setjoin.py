"""Candidate pairs of similar sets by their rarest members, complete for a given similarity.

Of two sets with enough members in common, each must have one of these among its rarest members; how many it must look at follows from
both sizes (Bayardo et al., 2007; Xiao et al., 2008). Sizes are cut into classes of 2 %, and a set is listed for every class a smaller
partner may be in with just as many members as that class needs. Sets that differ from a large family of copies in members of their
own are thus never paired with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable

RATIO = 1.02


def _needed(a: Column, b: Column, percent: int) -> Column:
    """How many members sets of these sizes must share."""
    return F.ceil((a + b) * percent / F.lit(100.0 + percent) - 1e-9)


def _class(n: Column) -> Column:
    return F.floor(F.log(n) / F.log(F.lit(RATIO)) + 1e-9).cast("int")


def prefix_pairs(members: DataFrame, percent: int) -> DataFrame:
    """members: node, component, n (size of the node's set), member (a hash); distinct rows. Gives a, b (a < b): at least the pairs in different components with a similarity of percent / 100."""
    common = durable(members.groupBy("member").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "common-members")
    counted = members.join(common.hint("merge"), "member", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    n = F.col("n")
    least = F.ceil(n * percent / F.lit(100.0) - 1e-9)
    longest = n - _needed(n, least, percent) + 1
    ranked = counted.withColumn("pos", F.row_number().over(Window.partitionBy("node").orderBy("df", "member"))).filter((F.col("pos") <= longest) & (F.col("df") > 1))
    ranked = durable(ranked.select("node", "component", "n", "member", "pos"), "rare-members")
    small = ranked.filter(F.col("pos") <= n - _needed(n, n, percent) + 1).select("member", _class(n).alias("class"), F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("component").alias("c_a"))
    each = ranked.withColumn("class", F.explode(F.sequence(_class(least), _class(n))))
    smallest = F.greatest(least, F.floor(F.pow(F.lit(RATIO), F.col("class")) - 1e-6))
    large = each.filter(F.col("pos") <= n - _needed(n, smallest, percent) + 1).select("member", "class", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("c_b"))
    met = small.join(large.hint("merge"), ["member", "class"]).filter((F.col("c_a") != F.col("c_b")) & (F.col("n_a") <= F.col("n_b")) & (F.col("n_a") * 100 >= F.col("n_b") * percent))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
