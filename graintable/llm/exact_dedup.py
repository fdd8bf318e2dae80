"""Exact dedup of an incoming batch against an immutable snapshot.

A snapshot keeps, for each bucket of digests, the distinct digests (with the smallest key and the number of rows) and a static binary
fuse filter over them (Graf and Lemire, 2022: three cells of one byte a digest, under 10 bits a digest in all, false positives 1 in 256).
An incoming batch is first reduced to its own distinct digests, whatever the snapshot holds. The filters screen these: a negative is
new for certain. Positives are joined to the snapshot's exact buckets by the whole digest, and then the texts themselves of both
representatives are compared byte by byte.

Digests are SHA-256 of the text after each run of blanks is made one space. Buckets are cut by digest, so they stay even however
many copies a text has; copies are counted before anything is shuffled. A filter is built and used inside one bucket, whose size is
bounded by KEYS_PER_BUCKET on average.

Defined cases: null texts count as empty and are equal to empty ones; the smallest key stays and null keys never do unless a group has
no other; rows that share a key stand or fall together, and a group without any key keeps all its rows, but for ``deduplicated``, which leaves one row of each text;
empty tables give empty results.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import durable, shared_dir
from .text import BLANKS, text_of

KEYS_PER_BUCKET = 1 << 14


def normalised(text: Column) -> Column:
    return F.regexp_replace(text_of(text), BLANKS, " ")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


# --- static binary fuse filters -------------------------------------------------------------------------------------------------


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) % 2**64)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def _shape(n: int) -> tuple[int, int]:
    """Cells of a segment (a power of two) and number of segments where a key's first cell may lie, for n keys."""
    segment = 1 << max(2, min(18, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    return segment, max(1, int(np.ceil(n * factor / segment)) - 2)


def _cells(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """The three cells of each hash: one in each of three neighbouring segments."""
    first = ((h >> np.uint64(32)) * np.uint64(segments * segment)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    base = first & ~mask
    step = np.uint64(segment)
    return np.stack([first, base + step + ((h >> np.uint64(16)) & mask), base + step + step + (h & mask)]).astype(np.int64)


def _mark(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(23))) & np.uint64(255)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> bytes:
    """The filter of distinct 64-bit keys: seed, segment and segments as 32-bit integers, then the cells.

    Cells that one key alone uses are peeled off, all of them at a time, until no key is left; the marks are then set in the opposite
    order. A seed with which peeling gets stuck is replaced by the next.
    """
    segment, segments = _shape(len(keys))
    size = (segments + 2) * segment
    for seed in range(1000):
        h = _mixed(keys, seed)
        cells = _cells(h, segment, segments)
        degree = np.bincount(cells.ravel(), minlength=size)
        users = np.zeros(size, np.int64)  # of a cell with one user left, that user
        for row in cells:
            np.add.at(users, row, np.arange(len(keys)))
        alive, order = np.ones(len(keys), bool), []
        single = np.flatnonzero(degree == 1)
        while len(single):
            who, at = np.unique(users[single], return_index=True)
            order.append((who, single[at]))
            alive[who] = False
            gone = cells[:, who]
            np.subtract.at(degree, gone.ravel(), 1)
            np.subtract.at(users, gone.ravel(), np.tile(who, 3))
            touched = np.unique(gone)
            single = touched[degree[touched] == 1]
        if not alive.any():
            break
    else:
        raise ValueError("keys must be distinct")
    table, marks = np.zeros(size, np.uint8), _mark(h)
    for who, cell in reversed(order):
        table[cell] = 0
        c = cells[:, who]
        table[cell] = marks[who] ^ table[c[0]] ^ table[c[1]] ^ table[c[2]]
    return np.array([seed, segment, segments], np.uint32).tobytes() + table.tobytes()


def may_contain(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """False only for keys that the filter was not built from."""
    seed, segment, segments = (int(x) for x in np.frombuffer(blob, np.uint32, 3))
    table = np.frombuffer(blob, np.uint8, offset=12)
    h = _mixed(keys, seed)
    c = _cells(h, segment, segments)
    return (table[c[0]] ^ table[c[1]] ^ table[c[2]]) == _mark(h)


def _short(digests: pd.Series) -> np.ndarray:
    """The 64 bits of each digest that the filters use."""
    return np.frombuffer(b"".join(d[8:16] for d in digests), np.uint64)


# --- the operator ---------------------------------------------------------------------------------------------------------------


def digests(docs: DataFrame, side: int) -> DataFrame:
    """docs: key, text. key, side, digest and h (a hash of the text as it is, to find it by)."""
    return docs.select("key", F.lit(side).alias("side"), digest_of(F.col("text")).alias("digest"), F.xxhash64("text").alias("h"))


def distinct_digests(rows: DataFrame) -> DataFrame:
    """rows: key, digest. One row for each digest: digest, rep (smallest key), n."""
    return rows.groupBy("digest").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("n"))


def _bucket(buckets: int) -> Column:
    return F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") % buckets


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    """snapshot: key, text. Written once to ``path``: its rows (key, side, digest, h), its exact buckets (digest, rep, n, bucket) and their filters. Batches are then screened against it without its texts being read."""
    spark = snapshot.sparkSession
    digests(snapshot, 0).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    buckets = max(1, rows.count() // KEYS_PER_BUCKET)
    distinct_digests(rows).withColumn("bucket", _bucket(buckets)).write.parquet(f"{path}/exact")

    def build(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": part["bucket"].iloc[:1], "filter": [build_filter(np.unique(_short(part["digest"])))], "buckets": [buckets]})

    exact = spark.read.parquet(f"{path}/exact").select("bucket", "digest")
    exact.groupBy("bucket").applyInPandas(build, "bucket long, filter binary, buckets long").write.parquet(f"{path}/filters")


def screen(groups: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """groups: digest, rep, n. Adds maybe: false if the snapshot can't have the digest."""

    def look(part: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        maybe = may_contain(found["filter"].iloc[0], _short(part["digest"])) if len(found) and len(part) else np.zeros(len(part), bool)
        return part[["digest", "rep", "n"]].assign(maybe=maybe)

    schema = f"digest binary, rep {groups.schema['rep'].dataType.simpleString()}, n long, maybe boolean"
    return groups.withColumn("bucket", _bucket(buckets)).groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(look, schema)


def dedup_batches(snapshot: DataFrame, batch: DataFrame, path: str | None = None) -> DataFrame:
    """Both: key, text. One row for each row of both: key, side (0 snapshot, 1 batch), digest, keep, n.

    ``path``: where ``write_snapshot`` has written this very snapshot. Of its texts only those that meet a text of the batch are then read.
    """
    spark = batch.sparkSession
    if path is None:
        path = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
        write_snapshot(snapshot, path)
    known, exact, filters = (spark.read.parquet(f"{path}/{name}") for name in ("rows", "exact", "filters"))
    incoming = durable(digests(batch, 1), "digests")
    rows = known.unionByName(incoming)
    buckets = filters.agg(F.coalesce(F.max("buckets"), F.lit(1))).first()[0]
    screened = durable(screen(distinct_digests(incoming), filters.drop("buckets"), buckets), "screened")
    positive = screened.filter("maybe").drop("maybe").withColumnRenamed("rep", "new_rep").withColumnRenamed("n", "new_n")
    joined = durable(exact.drop("bucket").join(positive, "digest"), "positives")

    # a text of each of the two representatives, byte by byte; the same join at every size, as the positives grow with the batch
    reps = joined.select("digest", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("rep").alias("key")), F.struct(F.lit(1).alias("side"), F.col("new_rep").alias("key")))).alias("w"))
    reps = reps.select(F.col("digest").alias("_digest"), F.col("w.side").alias("_side"), F.col("w.key").alias("_key"))
    found = rows.join(reps.hint("merge"), (F.col("digest") == F.col("_digest")) & (F.col("side") == F.col("_side")) & F.col("key").eqNullSafe(F.col("_key")))
    wanted = found.groupBy("_digest", "_side", "_key").agg(F.min("h").alias("_h"))
    both = snapshot.select("key", "text", F.lit(0).alias("side")).unionByName(batch.select("key", "text", F.lit(1).alias("side")))
    texts = both.join(wanted.hint("merge"), (F.xxhash64("text") == F.col("_h")) & (F.col("side") == F.col("_side")) & F.col("key").eqNullSafe(F.col("_key")))
    texts = texts.select("_digest", normalised(F.col("text")).alias("text")).filter(F.unhex(F.sha2("text", 256)) == F.col("_digest"))
    equal = texts.groupBy("_digest").agg((F.min("text") == F.max("text")).alias("equal")).filter("equal").select(F.col("_digest").alias("digest"))
    met = joined.join(equal, "digest").select("digest", F.least("rep", "new_rep").alias("keep"), (F.col("n") + F.col("new_n")).alias("n"))
    met = durable(met, "met")

    own = exact.select("digest", F.lit(0).alias("side"), F.col("rep").alias("keep"), "n").unionByName(screened.select("digest", F.lit(1).alias("side"), F.col("rep").alias("keep"), "n"))
    alone = own.filter("n > 1").join(met, "digest", "left_anti")
    shared = met.select("digest", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), "keep", "n")
    groups = durable(alone.unionByName(shared), "groups")  # of two rows at least
    out = rows.drop("h").join(groups, ["digest", "side"], "left")
    return out.select("key", "side", "digest", F.when(F.col("n").isNull(), F.col("key")).otherwise(F.col("keep")).alias("keep"), F.coalesce("n", F.lit(1)).cast("long").alias("n"))


def split_in_two(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """A table as a snapshot (half of its rows, by a hash of the key) and a batch (the rest)."""
    rows = docs.select(F.col(key).alias("key"), "text")
    side = F.pmod(F.xxhash64("key"), F.lit(2))
    return rows.filter(side == 0), rows.filter(side == 1)


def dropped(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The keys of docs of which every row is a copy of a row with a smaller key. Rows without a key are never dropped."""
    out = dedup_batches(*split_in_two(docs, key)).filter("key IS NOT NULL")
    return out.groupBy("key").agg(F.bool_or(F.col("key").eqNullSafe(F.col("keep"))).alias("stays")).filter(~F.col("stays")).select(F.col("key").alias(key))


ROW = "_row_of_key_and_text"


def row_hash(key: Column, digest: Column) -> Column:
    """Equal for rows of equal key and digest, null keys included."""
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), F.hex(digest)))


def singled(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """docs: with the column ROW. repeated: values of ROW. Of the rows of each of these values that with the smallest hash of all its columns; all other rows as they are."""
    if repeated.isEmpty():
        return docs
    row = F.struct(*[c for c in docs.columns if c != ROW])
    one = docs.join(repeated, ROW, "left_semi").groupBy(ROW).agg(F.min_by(row, F.md5(F.to_json(row))).alias("_one")).select(ROW, "_one.*")
    return docs.join(repeated, ROW, "left_anti").unionByName(one)


def deduplicated(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row of docs for each text: of equal texts a row with the smallest key (null keys last), of several rows with this key that with the smallest hash of all its columns."""
    out = dedup_batches(*split_in_two(docs, key))
    stays = F.bool_and(F.col("key").eqNullSafe(F.col("keep")))
    listed = out.groupBy(row_hash(F.col("key"), F.col("digest")).alias(ROW)).agg(stays.alias("stays"), F.count(F.lit(1)).alias("rows")).filter("not stays or rows > 1")
    listed = durable(listed, "exact-copies")
    marked = docs.withColumn(ROW, row_hash(F.col(key), digest_of(F.col("text"))))
    left = marked.join(listed.filter("not stays").select(ROW).hint("merge"), ROW, "left_anti")
    return singled(left, listed.filter("stays").select(ROW)).select(*docs.columns)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; one half, by hash of doc_id, is the snapshot that the other half is screened against."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_batches(*split_in_two(docs, "doc_id"))
    return out.select(
        F.col("key").alias("doc_id"),
        F.col("keep").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("key").eqNullSafe(F.col("keep")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


NORMALISED_SQL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"
ORACLE_SQL = f"""
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, t, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size FROM (SELECT doc_id, {NORMALISED_SQL} AS t FROM documents) WINDOW g AS (PARTITION BY t))
"""
