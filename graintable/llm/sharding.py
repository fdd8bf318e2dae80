"""Sharding by weighted rendezvous hashing.

Every record goes to the shard with the highest score ``-weight / ln(u)``, where u in (0, 1) is a hash of the record's key and the
shard's number. A further shard takes a record only if it wins, so records move into the new shard alone, and a removed shard
scatters only its own. Only DataFrame functions are used.

Slots number the rows of a shard from 0 without gaps. No task gets a whole shard: rows are numbered within the small hash buckets of
a shard, and the buckets' starts come from their counts (shards x BUCKETS rows at most), joined as Spark's size check finds best.

Defined cases: a null key is hashed as the word ``null``; a null text has no bytes (size 1, CRC 0); repeated rows are numbered one
after the other; an empty table gives an empty result; extra columns of any name are ignored by the query and kept by
``assign_shards``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import HASH_BITS, key_hash, key_hash_sql, text_of

SHARDS = 8
BUCKETS = 4096


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0, 1, ...) of a key. ``weights``: one for each shard; a weight of 0 closes it."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must not be negative, and one must be positive")
    scores = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            u = (key_hash(key, F.lit(shard)) + F.lit(0.5)) / F.lit(2.0**HASH_BITS)
            scores.append(F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("shard")))
    return -(F.array_max(F.array(*scores))["shard"])


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], shard: str = "shard") -> DataFrame:
    """``df`` with the column ``shard``; no shuffle."""
    return df.withColumn(shard, rendezvous(df[key], weights))


def slots(df: DataFrame, group: str, bucket: str, order: Sequence[str], slot: str = "slot") -> DataFrame:
    """``df`` with a gapless number from 0 within each ``group``, ordered by ``bucket`` (0 to BUCKETS - 1) and then by ``order``."""
    starts = (
        df.groupBy(group, bucket).count()
        .withColumn("_start", F.sum("count").over(Window.partitionBy(group).orderBy(bucket)) - F.col("count"))
        .drop("count")
    )
    row = F.row_number().over(Window.partitionBy(group, bucket).orderBy(*order))
    return (
        df.withColumn("_row", row).join(starts, [group, bucket])
        .withColumn(slot, (F.col("_row") - 1 + F.col("_start")).cast("long"))
        .drop("_row", "_start")
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of equal weight by the law ``key``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    placed = docs.select(
        "doc_id",
        (F.octet_length(text_of(F.col("text"))) + 1).cast("long").alias("size"),
        F.crc32(text_of(F.col("text"))).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col("doc_id"), [1.0] * SHARDS).alias("shard"),
        F.floor(key_hash(F.col("doc_id")) / F.lit(2.0**HASH_BITS / BUCKETS)).cast("int").alias("_bucket"),
        rendezvous(F.col("doc_id"), [1.0] * (SHARDS + 1)).alias("grown_shard"),
    )
    out = slots(placed, "shard", "_bucket", ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _winner(n: int) -> str:
    hashes = ", ".join(key_hash_sql(f"id || ':{i}'") for i in range(n))
    return f"(list_position([{hashes}], list_max([{hashes}])) - 1)::INTEGER"


#: DuckDB has no CRC-32: it is folded over the bytes with the table of its 256 one-byte remainders (polynomial 0xEDB88320).
_CRC_TABLE = [0] * 256
for _byte in range(256):
    _rest = _byte
    for _ in range(8):
        _rest = _rest >> 1 ^ (0xEDB88320 if _rest & 1 else 0)
    _CRC_TABLE[_byte] = _rest
_BYTES = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda c, x: xor(c >> 8, list_extract(crc_table, xor(c & 255, x) + 1))), 4294967295)"

ORACLE_SQL = f"""
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 1 AS size, {_CRC} AS text_crc32, {_winner(SHARDS)} AS shard, {_winner(SHARDS + 1)} AS grown_shard,
             floor({key_hash_sql("id")} / {2**HASH_BITS // BUCKETS}.0)::INTEGER AS bucket
      FROM (SELECT doc_id, text, coalesce(doc_id::VARCHAR, 'null') AS id, {_CRC_TABLE}::BIGINT[] AS crc_table FROM documents))
"""
