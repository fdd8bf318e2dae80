"""Price records: channel responses, and a view of the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import PRICE_RESPONSE


def read_price_responses(spark: SparkSession, path: str) -> DataFrame:
    """JSON responses of the price channels, one a line."""
    return spark.read.schema(PRICE_RESPONSE).json(path)


def response_records(responses: DataFrame) -> DataFrame:
    """The records of responses with code 200; a missing list counts as empty."""
    return responses.filter("code = 200").select(F.explode("data.list").alias("r")).select("r.*")


def response_errors(responses: DataFrame) -> DataFrame:
    """A row for every other response: code, message."""
    return responses.filter("code IS NULL OR code <> 200").select("code", F.coalesce("message", F.lit("unknown error")).alias("message"))


def price_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as price records; a line's unit price is the record's price. Dimension tables are joined by key and left to Spark to broadcast."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    cents = F.round(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("long")
    lines = read("lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("record_id"), "l_partkey", "l_suppkey", "l_returnflag",
        cents.alias("price_cents"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("releaseDate"),
    )
    parts = read("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("materialName"), F.col("p_brand").alias("brand"), F.col("p_type").alias("unit"), F.col("p_size").cast("string").alias("materialModelSpec"))
    places = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("city"), F.col("r_name").alias("province"))
    suppliers = read("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    channel = F.when(F.col("l_returnflag") == "A", "information_price").when(F.col("l_returnflag") == "N", "manufacturer_price").otherwise("zc_price")
    return (
        lines.join(parts, "l_partkey").join(suppliers.join(places, "n_nationkey"), "l_suppkey")
        .select("record_id", channel.alias("channel"), "materialName", "materialModelSpec", "brand", "unit", "province", "city", "releaseDate", "price_cents", (F.col("price_cents") / 100).alias("price"))
    )


PRICE_SQL = """price_records AS (SELECT l_orderkey || '-' || l_linenumber AS record_id,
    CASE l_returnflag WHEN 'A' THEN 'information_price' WHEN 'N' THEN 'manufacturer_price' ELSE 'zc_price' END AS channel,
    p_name AS materialName, p_size::VARCHAR AS materialModelSpec, p_brand AS brand, p_type AS unit, r_name AS province, n_name AS city,
    strftime(l_shipdate, '%Y-%m-%d') AS releaseDate, round(l_extendedprice * 100 / l_quantity)::BIGINT AS price_cents, round(l_extendedprice * 100 / l_quantity)::BIGINT / 100 AS price
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
