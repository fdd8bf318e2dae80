"""Price analysis by query and unit.

Everything works on distinct prices with their multiplicity: rows are counted by (query, unit, price) before anything is sorted, so a unit
that most records share costs no more than its distinct prices. These are ranked once, a large group in many ranges (``orderstats``), and
written; quartiles, medians, the best cut and the silhouette are then aggregates over ranks and running sums, combined before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable
from .orderstats import join_groups, quantile, running_sums

GROUP = ["query_id", "unit"]
UNKNOWN_UNIT = "UNKNOWN"
# fixed values: texts of the answers
NO_DATA, NO_VALID_DATA, FEW, FAILED = "无价格数据", "无有效价格数据", "样本过少", "分析失败: "
TABLE_EMPTY = "⚠️ 没有查询到材料信息"
HEAD = ("编号", "材料名称", "规格型号", "价格(元)", "单位", "省份", "城市", "发布时间")
BRAND = "品牌"


def valid_price(price: Column) -> Column:
    """A price as a double; null if it is null, blank, no number or not finite."""
    x = price.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def valid_prices(rows: DataFrame, price: str = "price") -> DataFrame:
    """Rows with a usable price, as a double."""
    return rows.withColumn(price, valid_price(F.col(price))).filter(F.col(price).isNotNull())


def unit_of(unit: Column) -> Column:
    return F.coalesce(F.nullif(unit, F.lit("")), F.lit(UNKNOWN_UNIT))


def distinct_prices(rows: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """rows: group, price. Gives group, price, m (how many rows have it); unusable prices are left out."""
    return valid_prices(rows.select(*group, "price")).groupBy(*group, "price").agg(F.count(F.lit(1)).alias("m"))


def counted_prices(rows: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """rows: group, price. Gives group, price (null if unusable), no_number (the text of a price that is no number, else null) and m, written: all that is read of the rows."""
    text = F.col("price").cast("string")
    no_number = F.when((F.trim(text) != "") & F.col("price").try_cast("double").isNull(), text)
    return durable(rows.select(*group, valid_price(F.col("price")).alias("price"), no_number.alias("no_number")).groupBy(*group, "price", "no_number").agg(F.count(F.lit(1)).alias("m")), "counted-prices")


def ranked_prices(counted: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """From ``counted_prices``: the distinct usable prices with m, r, s, n, total and part (see ``running_sums``), written."""
    return durable(running_sums(counted.filter("price is not null").select(*group, "price", "m"), group), "ranked-prices")


def _bounds(ranked: DataFrame, k: float, group: list[str]) -> DataFrame:
    q = ranked.groupBy(*group).agg(*[quantile(F.col("price"), F.col("r"), F.col("n"), p).alias(name) for name, p in (("q1", 0.25), ("q3", 0.75))])
    reach = k * (F.col("q3") - F.col("q1"))
    return q.select(*group, (F.col("q1") - reach).alias("low"), (F.col("q3") + reach).alias("high"))


def quartile_bounds(prices: DataFrame, k: float = 1.5, group: list[str] = GROUP) -> DataFrame:
    """prices: group, price, m. Gives group, low and high: the quartiles, interpolated, less or plus k times their distance."""
    return _bounds(running_sums(prices, group), k, group)


def _within(prices: DataFrame, bounds: DataFrame, group: list[str]) -> DataFrame:
    return join_groups(prices, bounds, group).filter(F.col("price").between(F.col("low"), F.col("high"))).drop("low", "high")


def remove_outliers(prices: DataFrame, k: float = 1.5, group: list[str] = GROUP) -> DataFrame:
    """The prices within the bounds, both included."""
    return _within(prices, quartile_bounds(prices, k, group), group)


def price_stats(rows: DataFrame, group: list[str] = GROUP, strict: bool = False) -> DataFrame:
    """rows: group, price. One row a group: total_count, invalid_count, valid_count (without outliers), min, max, mean, median, std, 95 % interval, and error.

    A price that is no number counts as invalid; if ``strict``, its group has an error and no statistics.
    """
    counted = counted_prices(rows, group)
    return _stats(counted, ranked_prices(counted, group), group, strict)


def _stats(counted: DataFrame, ranked: DataFrame, group: list[str], strict: bool = False) -> DataFrame:
    total = counted.groupBy(*group).agg(F.sum("m").alias("total_count"), F.coalesce(F.sum(F.when(F.col("price").isNotNull(), F.col("m"))), F.lit(0)).alias("usable"), F.min("no_number").alias("no_number"))
    failed = F.col("no_number").isNotNull() & F.lit(strict)
    kept = _within(ranked, _bounds(ranked, 1.5, group), group)
    x, m, r = F.col("price"), F.col("m"), F.col("r")
    # what is kept are neighbours: their ranks less what lies below
    stats = kept.groupBy(*group).agg(F.sum("m").alias("valid_count"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), (F.sum(x * m) / F.sum("m")).alias("mean_price"), F.min(r - m).alias("_below"))
    # deviations from the mean, as sums of squares alone lose digits
    spread = join_groups(kept, stats.select(*group, "mean_price", "valid_count", "_below"), group).groupBy(*group).agg(F.sum(F.pow(x - F.col("mean_price"), 2) * m).alias("squares"), quantile(x, r - F.col("_below"), F.col("valid_count"), 0.5).alias("median_price"))
    count = F.coalesce("valid_count", F.lit(0))
    std = F.when(count < 2, 0.0).otherwise(F.sqrt(F.col("squares") / (count - 1)))
    half = 1.96 * F.col("std_price") / F.sqrt("valid_count")
    error = F.when(failed, F.concat(F.lit(FAILED), "no_number")).when(F.col("total_count") == 0, NO_DATA).when(F.col("usable") == 0, NO_VALID_DATA)
    found = join_groups(total, join_groups(stats, spread, group), group, "left")
    values = ("valid_count", "min_price", "max_price", "mean_price", "median_price", "squares")
    return (
        found.withColumns({c: F.when(~failed, F.col(c)) for c in values})
        .withColumn("valid_count", count).withColumn("std_price", F.when(F.col("mean_price").isNotNull(), std))
        .select(*group, "total_count", (F.col("total_count") - F.col("usable")).alias("invalid_count"), "valid_count", "min_price", "max_price", "mean_price", "median_price", "std_price",
                F.when(F.col("valid_count") >= 2, F.col("mean_price") - half).alias("ci_low"), F.when(F.col("valid_count") >= 2, F.col("mean_price") + half).alias("ci_high"), error.alias("error"))
    )


def price_tiers(rows: DataFrame, group: list[str] = GROUP, least_silhouette: float = 0.5, least_gap: float = 0.3, least_share: float = 0.1) -> DataFrame:
    """One or two price levels of each group, from all usable prices, outliers included: group, mode, prices, reason, silhouette, gap.

    Two clusters of numbers are a cut of their sorted order, so the best cut and the mean silhouette come from running sums over the
    distinct prices: exact, where iterating from random centres finds a local optimum. Of equally good cuts the lowest is taken.
    """
    return _tiers(ranked_prices(counted_prices(rows, group), group), group, least_silhouette, least_gap, least_share)


def _tiers(p: DataFrame, group: list[str], least_silhouette: float = 0.5, least_gap: float = 0.3, least_share: float = 0.1) -> DataFrame:
    x, m = F.col("price"), F.col("m")
    rest = F.col("total") - F.col("s")
    gain = F.when(F.col("r") < F.col("n"), F.col("s") * F.col("s") / F.col("r") + rest * rest / (F.col("n") - F.col("r")))
    best = p.groupBy(*group).agg(F.max(F.when(gain.isNotNull(), F.struct(gain.alias("gain"), (-F.col("r")).alias("r"), F.col("s").alias("s")))).alias("best"))
    p = join_groups(p, best.select(*group, (-F.col("best.r")).alias("n_left"), F.col("best.s").alias("s_left")), group).withColumn("n_right", F.col("n") - F.col("n_left"))
    p = p.withColumn("m_left", F.col("s_left") / F.col("n_left")).withColumn("m_right", (F.col("total") - F.col("s_left")) / F.col("n_right"))
    left = F.col("r") <= F.col("n_left")
    size = F.when(left, F.col("n_left")).otherwise(F.col("n_right"))
    # sum of distances to the members of the own cluster: below (count and sum before this price) and above
    below_n = F.col("r") - m - F.when(left, 0).otherwise(F.col("n_left"))
    below_s = F.col("s") - x * m - F.when(left, 0.0).otherwise(F.col("s_left"))
    above_n = size - below_n - m
    above_s = F.when(left, F.col("s_left")).otherwise(F.col("total") - F.col("s_left")) - below_s - x * m
    a = (x * below_n - below_s + above_s - x * above_n) / (size - 1)
    b = F.when(left, F.col("m_right") - x).otherwise(x - F.col("m_left"))
    single = F.when(size == 1, 0.0).otherwise((b - a) / F.greatest(a, b))
    out = p.withColumn("one", single).groupBy(*group).agg(
        *[F.max(c).alias(c) for c in ("n", "n_left", "n_right", "m_left", "m_right", "total")],
        (F.sum(F.col("one") * m) / F.sum(m)).alias("silhouette"), quantile(x, F.col("r"), F.col("n"), 0.5).alias("median"),
    )
    mean = F.col("total") / F.col("n")
    gap = F.when(mean == 0, 0.0).otherwise((F.col("m_right") - F.col("m_left")) / mean)
    out = out.withColumn("silhouette", F.coalesce("silhouette", F.lit(-1.0))).withColumn("gap", F.coalesce(gap, F.lit(0.0)))
    small = F.coalesce(F.least("n_left", "n_right") < least_share * F.col("n"), F.lit(True))
    few = F.col("n") < 4
    two = ~few & (F.col("silhouette") >= least_silhouette) & (F.col("gap") >= least_gap) & ~small
    reason = F.when(few, FEW).when(two, "two clusters").when(F.col("silhouette") < least_silhouette, "clusters are not apart").when(F.col("gap") < least_gap, "levels are close").otherwise("one cluster is small")
    return out.select(*group, F.when(two, "two-tier").otherwise("single").alias("mode"), F.when(two, F.array(F.round("m_left", 2), F.round("m_right", 2))).otherwise(F.array("median")).alias("prices"), reason.alias("reason"), "silhouette", "gap")


def analyze_by_unit(rows: DataFrame) -> DataFrame:
    """rows: query_id, unit, price. Statistics and levels of each unit, with unit_rank: 1 for the most common (ties by name)."""
    named = rows.withColumn("unit", unit_of(F.col("unit")))
    counted = counted_prices(named)
    ranked = ranked_prices(counted)
    joined = join_groups(_stats(counted, ranked, GROUP), _tiers(ranked, GROUP).select(*GROUP, "mode", "prices", "reason"), GROUP, "left")
    return joined.withColumn("unit_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("total_count").desc(), "unit")))


def most_common_unit(rows: DataFrame) -> DataFrame:
    """query_id and the unit that most of its rows have (ties by name)."""
    counts = rows.groupBy("query_id", unit_of(F.col("unit")).alias("unit")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("query_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "unit")).alias("top")).select("query_id", F.col("top.unit").alias("unit"))


def most_common_unit_records(rows: DataFrame) -> DataFrame:
    """The rows of each query's most common unit."""
    return rows.withColumn("unit", unit_of(F.col("unit"))).join(most_common_unit(rows), GROUP, "left_semi")


def price_histogram(rows: DataFrame, bins: int = 5, group: list[str] = GROUP) -> DataFrame:
    """Equal bins, closed on the right, with empty ones: group, bin (from 1), label and count."""
    prices = distinct_prices(rows, group)
    range_ = prices.groupBy(*group).agg(F.min("price").alias("low"), F.max("price").alias("high"))
    flat = F.col("low") == F.col("high")
    pad = F.when(F.col("low") == 0, 0.001).otherwise(0.001 * F.abs("low"))
    edges = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / bins)
    range_ = range_.withColumn("lo", F.when(flat, F.col("low") - pad).otherwise(F.col("low"))).withColumn("hi", F.when(flat, F.col("high") + pad).otherwise(F.col("high"))).withColumn("edges", edges)
    # only the label's first edge moves left, by a thousandth of the range
    shown = F.transform("edges", lambda e, i: F.round(F.when((i == 0) & ~flat, e - 0.001 * (F.col("hi") - F.col("lo"))).otherwise(e), 3))
    range_ = range_.withColumn("shown", shown)
    whole = lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("long").cast("string")
    every = range_.select(*group, F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"), "shown").select(*group, "bin", F.concat(whole(F.element_at("shown", F.col("bin"))), F.lit("-"), whole(F.element_at("shown", F.col("bin") + 1))).alias("label"))
    binned = prices.join(range_.select(*group, "edges"), group).withColumn("bin", F.greatest(F.lit(1), F.size(F.filter("edges", lambda e: e < F.col("price")))))
    counts = binned.groupBy(*group, F.least("bin", F.lit(bins)).alias("bin")).agg(F.sum("m").alias("n"))
    return every.join(counts, [*group, "bin"], "left").select(*group, "bin", "label", F.coalesce("n", F.lit(0)).cast("long").alias("count"))


def price_points(rows: DataFrame, date: str = "releaseTime") -> DataFrame:
    """month and price of every row that has both (a price of 0 counts as missing)."""
    month = F.substring(date, 1, 7)
    return rows.withColumn("month", month).withColumn("price", valid_price(F.col("price"))).filter((F.coalesce("month", F.lit("")) != "") & (F.col("price") != 0))


def price_time_series(rows: DataFrame, date: str = "releaseTime", group: str = "query_id") -> DataFrame:
    """Per month: number of points, mean, least and greatest price."""
    return price_points(rows, date).groupBy(group, "month").agg(F.count(F.lit(1)).alias("points"), F.avg("price").alias("mean_price"), F.min("price").alias("min_price"), F.max("price").alias("max_price"))


def chart_gate(rows: DataFrame, threshold: int = 10) -> DataFrame:
    """query_id, n and whether there are enough rows for a chart; below that the table alone is shown."""
    return rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).select("query_id", "n", (F.col("n") > threshold).alias("chart"))


def _cell(c: str) -> Column:
    s = F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\\", "/")
    return F.replace(F.replace(s, F.lit("\n"), F.lit(" / ")), F.lit("\r"), F.lit(" "))


def render_md_table(rows: DataFrame, queries: DataFrame, top_n: int, order: str = "record_id") -> DataFrame:
    """query_id and a Markdown table of its first top_n rows; manufacturer prices have a brand column. Rows are cut to top_n before they are gathered."""
    fields = ("materialName", "materialModelSpec", "brand", "price", "unit", "province", "city", "releaseDate")
    numbered = rows.withColumn("_i", F.row_number().over(Window.partitionBy("query_id").orderBy(order))).filter(F.col("_i") <= top_n)
    texts = numbered.select("query_id", "_i", *[_cell(f).alias(f) for f in fields])
    brand = F.col("channel") == "manufacturer_price"
    line = lambda names: F.concat(F.lit("| "), F.array_join(F.array(F.col("_i").cast("string"), *names), " | "), F.lit(" |"))
    with_brand, plain = line([F.col(f) for f in fields]), line([F.col(f) for f in fields if f != "brand"])
    channels = queries.select("query_id", "channel")
    lines = texts.join(channels, "query_id").select("query_id", F.struct("_i", F.when(brand, with_brand).otherwise(plain).alias("line")).alias("x"))
    body = lines.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("body"))
    head = lambda names: "| " + " | ".join(names) + " |\n|" + "------|" * len(names)
    header = F.when(brand, head((*HEAD[:3], BRAND, *HEAD[3:]))).otherwise(head(HEAD))
    out = channels.join(body, "query_id", "left")
    return out.select("query_id", F.when(F.col("body").isNull(), TABLE_EMPTY).otherwise(F.concat(header, F.lit("\n"), F.col("body"))).alias("table"))


def token_savings(answers: DataFrame) -> DataFrame:
    """answers: query_id, original_count, entities_json, results_json. llm_tokens and how much less that is than all records would take, in per cent."""
    tokens = F.floor(F.length(F.concat_ws("\n", "entities_json", "results_json")) / 2).cast("long")
    rate = F.round((1 - F.col("llm_tokens") / F.nullif(F.col("original_count") * 120, F.lit(0))) * 100, 1)
    return answers.withColumn("llm_tokens", tokens).select("query_id", "original_count", "llm_tokens", rate.alias("token_optimization_rate"))
