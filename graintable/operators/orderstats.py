"""Exact order statistics of values with multiplicities, without a task that holds a whole group.

A group with many distinct values is cut into ranges at approximate quantiles (a mergeable sketch of bounded size; where the cuts fall
changes nothing but the work). Ranges are summed, the sums are added up over the few ranges of a group, and rows are ranked within their own
range from where the ranges before it ended. With each value's rank known, a quantile is the least value whose rank exceeds a position: an
aggregate that is combined before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = 50_000  # distinct values of a group that are ranked in one task
RANGES = 256  # for a group with more


def join_groups(rows: DataFrame, groups: DataFrame, group: list[str], how: str = "inner") -> DataFrame:
    """rows with the columns of groups, one row for each group; null is a group like any other."""
    renamed = groups.withColumnsRenamed({g: f"_of_{g}" for g in group})
    on = [rows[g].eqNullSafe(renamed[f"_of_{g}"]) for g in group]
    return rows.join(renamed, on, how).drop(*[f"_of_{g}" for g in group])


def _ranges(values: DataFrame, group: list[str], value: str, large: DataFrame, ranges: int) -> DataFrame:
    """values with part, the number of a value's range: 0 but in large groups."""
    cuts = join_groups(values, large.withColumn("_large", F.lit(True)), group).groupBy(*group).agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 20 * ranges).alias("_cuts"))
    dealt = join_groups(values, cuts, group, "left").withColumn("part", F.lit(0))
    # the number of cuts below a value, by halving; behind the last cut, and without cuts, there is null, which adds nothing
    step = 1 << (ranges - 1).bit_length() >> 1
    while step:
        dealt = dealt.withColumn("part", F.col("part") + F.when(F.get("_cuts", F.col("part") + (step - 1)) < F.col(value), step).otherwise(0))
        step //= 2
    return dealt.drop("_cuts")


def running_sums(values: DataFrame, group: list[str], value: str = "price", range_rows: int = RANGE, ranges: int = RANGES) -> DataFrame:
    """values: ``group``, ``value``, m; distinct values, a written table at best, as they are read several times. Adds r and s (how many there
    are up to this value, and their sum), n and total (of the group), and part, the number of the range."""
    x, m = F.col(value), F.col("m")
    large = values.groupBy(*group).agg(F.count(F.lit(1)).alias("_d")).filter(F.col("_d") > range_rows).drop("_d")
    whole = Window.partitionBy(*group)
    if large.isEmpty():  # every group is a range by itself
        upward = whole.orderBy(value)
        return values.select(*group, value, "m", F.sum("m").over(upward).alias("r"), F.sum(x * m).over(upward).alias("s"), F.sum("m").over(whole).alias("n"), F.sum(x * m).over(whole).alias("total"), F.lit(0).alias("part"))
    dealt = _ranges(values, group, value, large, ranges)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*group, "part").agg(F.sum("m").alias("_n"), F.sum(x * m).alias("_s"))
    starts = sums.select(*group, "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_s0"), F.sum("_n").over(whole).alias("n"), F.sum("_s").over(whole).alias("total"))
    within = Window.partitionBy(*group, "part").orderBy(value)
    ranked = dealt.withColumn("_r", F.sum("m").over(within)).withColumn("_q", F.sum(x * m).over(within))
    out = join_groups(ranked, starts, [*group, "part"])
    return out.select(*group, value, "m", (F.col("_n0") + F.col("_r")).alias("r"), (F.col("_s0") + F.col("_q")).alias("s"), "n", "total", "part")


def quantile(value: Column, r: Column, n: Column, p: float) -> Column:
    """An aggregate: the quantile p, interpolated between neighbours. ``r``: rank of a value, its equals included; ``n``: size of the group, the same in all its rows."""
    at = (n - 1) * F.lit(p)
    low, high = F.min(F.when(r > F.floor(at), value)), F.min(F.when(r > F.ceil(at), value))
    share = F.max(at - F.floor(at))
    return F.when(share == 0, low).otherwise((1 - share) * low + share * high)
