"""What several operators share: words, blanks and hashes that Spark and SQL compute alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 52


def text_of(text: Column) -> Column:
    """The text, a null counting as empty."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Number of words of the whole text (null: 0)."""
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def key_hash(*parts: Column) -> Column:
    """The first 52 bits of the MD5 of the parts joined by colons, as a long; a null part counts as the word null."""
    joined = F.concat_ws(":", *[F.coalesce(x.cast("string"), F.lit("null")) for x in parts])
    return F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("long")


def key_hash_sql(expression: str) -> str:
    """``key_hash`` in DuckDB; ``expression`` is the joined string."""
    return f"('0x' || substr(md5({expression}), 1, 13))::BIGINT"
