"""Order statistics by ranges against numpy, and large groups over many tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graintable.operators import analysis, orderstats

SCHEMA = "query_id long, unit string, price double"


@pytest.mark.parametrize(("range_rows", "ranges"), [(1, 4), (3, 2), (10, 256), (50_000, 256)])
def test_running_sums(spark, range_rows, ranges):
    """Equal results wherever a group is cut; null is a group too."""
    rng = np.random.default_rng(ranges)
    groups = {(1, "t"): rng.integers(0, 50, 300), (2, None): rng.integers(-5, 5, 80), (None, None): np.array([7]), (3, "x"): np.array([1, 1, 1])}
    rows = [(*g, float(x)) for g, xs in groups.items() for x in xs]
    prices = analysis.distinct_prices(spark.createDataFrame(rows, SCHEMA))
    got = orderstats.running_sums(prices, analysis.GROUP, range_rows=range_rows, ranges=ranges).collect()
    assert len(got) == sum(len(set(xs.tolist())) for xs in groups.values())
    for r in got:
        xs = groups[r["query_id"], r["unit"]]
        below = xs[xs <= r["price"]]
        assert (r["m"], r["r"], r["s"], r["n"], r["total"]) == ((xs == r["price"]).sum(), len(below), below.sum(), len(xs), xs.sum())
    assert len({r["part"] for r in got if r["query_id"] == 1}) > 1 or range_rows > 50


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.75, 0.9, 1.0])
def test_quantiles(spark, p):
    rng = np.random.default_rng(7)
    groups = {g: rng.integers(0, 20, n) / 4 for g, n in enumerate((1, 2, 3, 4, 5, 50, 51))}
    prices = analysis.distinct_prices(spark.createDataFrame([(g, "u", float(x)) for g, xs in groups.items() for x in xs], SCHEMA))
    sums = orderstats.running_sums(prices, analysis.GROUP, range_rows=4, ranges=3)
    got = sums.groupBy("query_id").agg(orderstats.quantile(F.col("price"), F.col("r"), F.col("n"), p).alias("q")).collect()
    assert all(np.isclose(r["q"], np.quantile(groups[r["query_id"]], p)) for r in got) and len(got) == len(groups)


def test_a_large_group_is_ranked_by_many_tasks(spark):
    """A million distinct prices of one unit beside small units: the same figures as numpy's, no part with more than a small share."""
    hot = spark.range(1_000_000).select(F.lit(1).cast("long").alias("query_id"), F.lit("t").alias("unit"), (F.pow(F.col("id") / 1000.0, 2) + 1).alias("price"))
    small = spark.range(50).select((F.col("id") % 5 + 2).alias("query_id"), F.lit("t").alias("unit"), F.col("id").cast("double").alias("price"))
    rows = hot.unionByName(small)
    ranked = analysis.ranked_prices(analysis.counted_prices(rows))
    parts = ranked.groupBy("query_id", "part").count().collect()
    assert max(r["count"] for r in parts) < 12_000 and sum(r["query_id"] == 1 for r in parts) > 200 and sum(r["query_id"] > 1 for r in parts) == 5
    x = (np.arange(1_000_000) / 1000.0) ** 2 + 1
    q1, q3 = np.quantile(x, [0.25, 0.75])
    kept = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
    (r,) = analysis.analyze_by_unit(rows).filter("query_id = 1").collect()
    assert r["valid_count"] == len(kept) and np.allclose([r["min_price"], r["max_price"], r["mean_price"], r["median_price"], r["std_price"]], [kept.min(), kept.max(), kept.mean(), np.median(kept), kept.std(ddof=1)])
    # the best of all cuts, from prefix sums of the sorted prices
    s, n = np.cumsum(x), np.arange(1, len(x) + 1)
    gain = s[:-1] ** 2 / n[:-1] + (s[-1] - s[:-1]) ** 2 / (n[-1] - n[:-1])
    cut = int(np.argmax(gain)) + 1
    assert r["mode"] == "two-tier" and np.allclose(list(r["prices"]), [round(x[:cut].mean(), 2), round(x[cut:].mean(), 2)])


def test_no_window_or_buffer_of_a_group(spark):
    rows = spark.createDataFrame([(1, "t", 1.0), (1, "t", 2.0)], SCHEMA)
    plans = [orderstats.running_sums(analysis.distinct_prices(rows), analysis.GROUP, range_rows=1), analysis.price_stats(rows), analysis.price_tiers(rows)]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert " percentile(" not in plan and "collect_list" not in plan
        windows = [line for line in plan.splitlines() if "Window [" in line and "windowspecdefinition" in line]
        # but for windows over the sums of a group's ranges, which are few
        assert all("part#" in line or "_n#" in line for line in windows)
