"""Which names hold which others: a join by substring without comparing all names.

The strings that may be the longer ones are indexed by their grams of one to three characters. A shorter one is looked up by a single
gram: of its grams of three characters (or itself, if it has fewer) the one that fewest longer strings have. So a pair is met once at
most, and a string has as many candidates as its rarest gram, not as there are names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENGTH = 3


def _grams(s: Column, n: int) -> Column:
    """The distinct grams of n characters. Characters are split once: a substring of each place would read the string each time."""
    chars = F.split(s, "")
    at = F.sequence(F.lit(0), F.length(s) - n)
    each = F.transform(at, lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))
    return F.when(F.length(s) >= n, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def substring_candidates(short: DataFrame, long: DataFrame, group: str = "channel") -> DataFrame:
    """short: ``group``, s. long: ``group``, l. Distinct rows each. Gives ``group``, s and l of the pairs that share the rarest gram of s; all pairs
    in which l holds s are among them. Null and empty strings are in no pair."""
    index = long.filter("l <> ''").select(group, "l", F.explode(F.concat(*[_grams(F.col("l"), n) for n in range(1, LENGTH + 1)])).alias("gram"))
    frequency = index.groupBy(group, "gram").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.length("s") < LENGTH, F.array("s")).otherwise(_grams(F.col("s"), LENGTH))
    looked_up = short.filter("s <> ''").select(group, "s", F.explode(own).alias("gram")).join(frequency, [group, "gram"], "left")
    # a gram that no longer string has rules the string out
    rarest = looked_up.groupBy(group, "s").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).filter("r.n > 0")
    return rarest.select(group, "s", F.col("r.gram").alias("gram")).join(index, [group, "gram"]).select(group, "s", "l")


def substring_pairs(short: DataFrame, long: DataFrame, group: str = "channel") -> DataFrame:
    """As ``substring_candidates``, only the pairs in which l holds s."""
    return substring_candidates(short, long, group).filter(F.col("l").contains(F.col("s")))


def either_holds(a: DataFrame, b: DataFrame, group: str = "channel") -> DataFrame:
    """a: ``group``, a. b: ``group``, b. Distinct rows each. Gives ``group``, a and b of the pairs of which one holds the other, each once; empty strings are in no pair."""
    within = substring_pairs(b.withColumnRenamed("b", "s"), a.withColumnRenamed("a", "l"), group).select(group, F.col("l").alias("a"), F.col("s").alias("b"))
    around = substring_pairs(a.withColumnRenamed("a", "s"), b.withColumnRenamed("b", "l"), group).select(group, F.col("s").alias("a"), F.col("l").alias("b"))
    return within.unionByName(around.filter("a <> b"))
