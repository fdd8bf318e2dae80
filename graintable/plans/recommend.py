"""Price recommendation: from queries to statistics, levels and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import durable
from ..operators import analysis, fuzzy, prices


def recommend_prices(records: DataFrame, queries: DataFrame, top_n: int = 10, enforce_volume: bool = False, widths: bool = True) -> DataFrame:
    """One row a query: success, message, total_count, matched_count, level, the most common unit with its statistics and price levels, a table of its first records and token_optimization_rate.

    Queries meet the records of their channel in one join, whose result is written once, as are the matches whose names score high enough:
    counts, statistics, levels and tables all read these. With ``enforce_volume``, queries
    with more than a thousand matches are refused instead of analysed.
    """
    matches = durable(prices.filter_prices(records, queries), "matches")
    counts = prices.count_matches(matches, queries)
    volume = prices.volume_report(counts)
    limited = prices.limit_per_query(matches, queries)
    if enforce_volume:
        limited = limited.join(volume.filter("can_process").select("query_id"), "query_id", "left_semi")
    found = durable(fuzzy.fuzzy_match(queries, limited, widths=widths).withColumn("unit", analysis.unit_of(F.col("unit"))), "scored-matches")
    by_unit = analysis.analyze_by_unit(found).filter("unit_rank = 1")
    table = analysis.render_md_table(analysis.most_common_unit_records(found), prices.with_channel(queries), top_n)
    matched = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("matched_count"))
    unit = by_unit.withColumnRenamed("total_count", "unit_count")
    out = volume.join(matched, "query_id", "left").join(unit, "query_id", "left").join(table, "query_id", "left")
    refused = (~F.col("can_process")) & F.lit(enforce_volume)
    ok = F.col("unit_count").isNotNull()
    message = F.when(refused, "too many records").when(~ok, "no matching records").otherwise("ok")
    result = F.to_json(F.struct("unit", "min_price", "max_price", "mean_price", "median_price", "mode", "prices"))
    tokens = F.floor((F.length(result) + F.length("table")) / 2)
    rate = F.round((1 - tokens / F.nullif(F.col("estimated_tokens"), F.lit(0))) * 100, 1)
    return out.select(
        "query_id", ok.alias("success"), message.alias("message"), "total_count", F.coalesce("matched_count", F.lit(0)).cast("long").alias("matched_count"), "level",
        "unit", "valid_count", "min_price", "max_price", "mean_price", "median_price", "mode", "prices", "table", F.when(ok, rate).alias("token_optimization_rate"),
    )
