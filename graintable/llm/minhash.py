"""Near-duplicate documents by MinHash with tensored banding.

A document's set holds its shingles of ``width`` words. Instead of an own group of hashes for each table, two collections of COUNT
half keys of HALF minhashes each are computed, and every pair of one half key from either makes a table's key: COUNT ** 2 tables from
2 * COUNT * HALF minhashes (Christiani, 2017). Two sets of similarity s meet in a table with probability (1 - (1 - s ** HALF) ** COUNT) ** 2; at 0.8
with HALF = 2, COUNT = 10 that is 0.99993, and more for every further chain of links between them.

Documents with equal sets are one class and are compared once. In a table, each class of a key is compared to the key's smallest
class, not to all others; the links found are joined to components. Only keys that still hold several components are looked at
again: all of their classes are joined by their rarest shingles (``setjoin``, complete for the similarity), and the pairs of different components
that this finds are compared. So no candidate pair that could join two components goes unchecked, and no key's pairs are all written out. Each
comparison takes the whole sets (as 64-bit hashes).

Defined cases: a null text or one without words has the empty set (n_shingles 0) and is linked with nothing; a text of fewer words than
``width`` has its whole sequence as its one shingle; a row with a null key has no component (null), is linked with nothing and kept; rows that
share a key share its links and stand or fall together; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import durable
from .components import connected_components
from .exact_dedup import ROW, row_hash, singled
from .setjoin import prefix_pairs
from .text import text_of

WIDTH, PERCENT = 5, 80
HALF, COUNT = 2, 10
PIECE = 1 << 22  # bytes of a text that are split into words at a time
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = np.random.default_rng(20170801).integers(1, 2**63, (64, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, A to Z taken as a to z."""
    from xxhash import xxh3_64_intdigest

    data, out, at = (text or "").encode("utf-8", "surrogatepass"), [], 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        words = data[at:end].translate(LOWER).split()
        out.append(np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str | None, width: int) -> np.ndarray:
    """The set of hashed shingles of a text, ascending."""
    words = word_hashes(text)
    width = min(width, len(words))
    if not width:
        return words
    out = words[: len(words) - width + 1].copy()
    for k in range(1, width):
        out = _mix(out) * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - width + 1 + k]
    return np.unique(_mix(out))


def half_keys(hashes: np.ndarray, half: int, count: int) -> np.ndarray:
    """2 * count keys, each of half minhashes of a set that isn't empty."""
    factors = _ODD.ravel()[: 2 * count * half, None]
    least = np.full(len(factors), 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 1 << 13):
        np.minimum(least, (factors * hashes[at : at + (1 << 13)]).min(1), out=least)
    keys = np.zeros(2 * count, np.uint64)
    for column in least.reshape(2 * count, half).T:
        keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + column + np.uint64(1))
    return keys.view(np.int64)


def signatures(docs: DataFrame, width: int, half: int = HALF, count: int = COUNT) -> DataFrame:
    """docs: id, text. Gives id, n (size of the set), digest (of the set), a and b (half keys; null if the set is empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            sizes, digests, a, b = [], [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py(), width)
                keys = half_keys(found, half, count) if len(found) else None
                sizes.append(len(found))
                digests.append(xxh3_128_digest(found.tobytes()))
                a.append(None if keys is None else keys[:count])
                b.append(None if keys is None else keys[count:])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(a, longs), pa.array(b, longs)], ["id", "n", "digest", "a", "b"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(run, f"id {kind}, n long, digest binary, a array<long>, b array<long>")


def _alike(a: str, b: str, percent: int) -> F.Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def texts_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """wanted: id. docs: id, text. The wanted texts, written. They are shuffled in the same way at every size, as they grow with the input."""
    return durable(docs.join(wanted.distinct().hint("merge"), "id").select("id", "text"), "texts")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """pairs: a, b. texts: id, text. Those pairs whose whole sets have a similarity of percent / 100 or more. A text that is in many pairs is split by adaptive execution."""
    pairs = durable(pairs, "pairs")
    second = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = second.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for text_a, text_b in zip(batch.column(2), batch.column(3), strict=True):
                text = text_a.as_py()
                if text != last:  # pairs of one class mostly come together
                    last, first = text, shingles(text, width)
                other = shingles(text_b.as_py(), width)
                shared = len(np.intersect1d(first, other, assume_unique=True))
                keep.append(shared * 100 >= (len(first) + len(other) - shared) * percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    return durable(both.mapInArrow(run, f"u {kind}, v {kind}"), "verified")


def members_of(texts: DataFrame, width: int) -> DataFrame:
    """texts: id, text. A row for each shingle of each set: node, n, member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in enumerate(batch.column(1)):
                found = shingles(text.as_py(), width)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([row] * len(found), pa.int64())), pa.array([len(found)] * len(found), pa.int64()), pa.array(found.view(np.int64))], ["node", "n", "member"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInArrow(run, f"node {kind}, n long, member long").distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, half: int = HALF, count: int = COUNT) -> DataFrame:
    """docs: id, text. One row for each row: id, n_shingles, component (the smallest id linked with it, directly or by others) and kept."""
    signed = durable(signatures(docs, width, half, count), "signatures")
    usable = signed.filter("n > 0 and id is not null")
    classes = durable(usable.groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("a").alias("a"), F.first("b").alias("b")), "classes")
    first = classes.select("rep", "n", F.posexplode("a").alias("i", "x"), "b")
    rows = first.select("rep", "n", "i", "x", F.posexplode("b").alias("j", "y")).select(F.xxhash64("i", "x", "j", "y").alias("key"), "rep", "n")
    heads = rows.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("head"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = durable(heads.select("key", F.col("head.rep").alias("head"), F.col("head.n").alias("head_n")), "heads")

    met = rows.join(shared, "key")
    texts = texts_of(met.select(F.col("rep").alias("id")), docs)
    tested = durable(met.filter((F.col("rep") != F.col("head")) & _alike("n", "head_n", percent)).select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct(), "tested")
    links = verified(tested, texts, width, percent)
    found = connected_components(links)

    # classes of keys that hold several components: those that may be linked with one of another component
    placed = met.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    placed = durable(placed, "placed")
    several = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    loose = durable(placed.join(several, "key").select(F.col("rep").alias("node"), "component").distinct(), "loose")
    loose_texts = texts.join(loose.select(F.col("node").alias("id")), "id", "left_semi")
    members = durable(members_of(loose_texts, width).join(loose, "node"), "members")
    rest = prefix_pairs(members, percent).join(tested, ["a", "b"], "left_anti")
    links = links.unionByName(verified(rest, texts, width, percent))

    found = durable(connected_components(links), "components")
    of_class = classes.select("digest", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = signed.join(durable(of_class, "class-components"), "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component")).withColumn("kept", F.col("id").eqNullSafe(F.col("component")))


NO_KEY = 1 << 62


def deduplicated(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs that no near duplicate with a smaller key stands for; of rows of equal key and text one. ``key``: an integer below NO_KEY.

    Rows without a key take part with a number above all keys, drawn from their text. Rows that share a key and differ in text stand or fall together.
    """
    number = F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY) + F.xxhash64("text").bitwiseAND((1 << 61) - 1))
    numbered = docs.withColumn("_number", number).withColumn(ROW, row_hash(F.col("_number"), F.unhex(F.md5(text_of(F.col("text"))))))
    repeated = durable(numbered.groupBy(ROW).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(ROW), "repeated")
    out = near_duplicates(numbered.select(F.col("_number").alias("id"), "text"))
    gone = out.groupBy("id").agg(F.bool_or("kept").alias("stays")).filter(~F.col("stays")).select(F.col("id").alias("_number"))
    left = numbered.join(durable(gone, "near-copies").hint("merge"), "_number", "left_anti")
    return singled(left, repeated).select(*docs.columns)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by shingles of two words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    out = near_duplicates(docs, width=2)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")
