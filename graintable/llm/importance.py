"""Importance resampling towards a target distribution: documents are drawn by how much their n-grams look like the target's.

Batch concatenation: the texts of a batch are joined by a sentinel that no word holds, one pass of a regular expression finds the words
of all of them, and ``searchsorted`` over the documents' ends tells which document a word is of. An n-gram counts only where its first
and last word are of one document; the rest is masked before ``bincount``. Batches are cut to SLICE bytes, a longer text being a batch
of its own.

Features are hashed to a fixed number of buckets. The corpus and the target are counted once each (a task gives one row for each
bucket, whatever it read), and a bucket's gain is the logarithm of the ratio of its two smoothed frequencies, in thousandths. A document's weight is
the mean gain of its features; with Gumbel noise from a hash of its key added, the highest scores are a sample without replacement.

Nothing is sorted as a whole: scores are integers within a fixed range, so their histogram is small and gives both the lowest score
that is drawn and the first rank of each score. A score has few keys, as the noise spreads them; repeated rows are counted before they meet.

Defined cases: a null or empty text has no words, no features and weight 0; documents with fewer than ``least_words`` words have a score
but aren't drawn; a null key is hashed as the word ``null`` and comes last among equal scores; repeated rows have equal scores and take
consecutive ranks; of the last score rows with the smallest keys are drawn; an empty corpus gives an empty result, an empty target makes
rare features gain most; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..durable import durable
from . import sharding

# bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F]: every byte of a character beyond ASCII is above \x7F
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
IS_WORD = np.array([WORD.match(bytes([b])) is not None for b in range(256)])
SENTINEL = b"\n"
SLICE = 4 << 20
KNOWN = 1 << 18  # words whose hash a worker remembers
CHUNK = 10_000  # equal rows that one task writes


class _Hashes(dict):
    """CRC-32 of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        found = self[word] = zlib.crc32(word)
        return found


class Grams:
    """Features of batches of texts."""

    def __init__(self, longest: int, buckets: int):
        self.longest, self.buckets, self.hashes = longest, buckets, _Hashes()

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """The number of words of each text, and for each length of n-gram: the text's number and the bucket of each feature."""
        joined = SENTINEL.join(texts).lower()  # of bytes: A-Z only
        ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
        words = WORD.findall(joined)
        inside = IS_WORD[np.frombuffer(SENTINEL + joined, np.uint8)]
        starts = np.flatnonzero(inside[1:] & ~inside[:-1])
        doc = np.searchsorted(ends, starts, "right")
        # each distinct word of the batch is hashed once
        coded = pa.array(words, pa.binary()).dictionary_encode()
        of_word = np.fromiter(map(self.hashes.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()), np.int64, len(coded.dictionary))
        crcs = of_word[coded.indices.to_numpy()]
        found = [(doc, crcs % self.buckets)]
        for n in range(2, self.longest + 1):
            # the hash of a longer n-gram goes on from that of the shorter one
            crcs = np.fromiter((zlib.crc32(b" " + word, crc) for crc, word in zip(crcs.tolist(), words[n - 1 :], strict=False)), np.int64, max(len(words) - n + 1, 0))
            whole = doc[: len(crcs)] == doc[n - 1 :]
            found.append((doc[: len(crcs)][whole], crcs[whole] % self.buckets))
        return np.bincount(doc, minlength=len(texts)), found


def _slices(column: pa.Array) -> Iterator[list[bytes]]:
    held, size = [], 0
    for value in column:
        text = value.as_py() or b""
        if held and size + len(text) > SLICE:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def bucket_counts(df: DataFrame, text: str = "text", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """bucket, n: how often features of the bucket occur in all texts; buckets without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total = Grams(longest, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for texts in _slices(batch.column(0)):
                for _, bucket in grams(texts)[1]:
                    total += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    parts = df.select(F.col(text).cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of smoothed frequencies' ratios, by bucket, rounded down."""
    buckets = len(corpus)
    all_corpus, all_target = float(corpus.sum() + buckets), float(target.sum() + buckets)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_corpus / ((s + 1.0) * all_target))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(df: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", longest: int = 1) -> DataFrame:
    """``key``, n_words, n_features and weight: the floored mean of the features' gains (without features 0)."""
    buckets = len(gain)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(longest, buckets)
        for batch in batches:
            words, features, sums = [], [], []
            for texts in _slices(batch.column(1)):
                n, found = grams(texts)
                words.append(n)
                features.append(sum(np.bincount(doc, minlength=len(texts)) for doc, _ in found))
                # sums of whole numbers below 2 ** 53 are exact
                sums.append(sum(np.bincount(doc, gain[bucket], len(texts)) for doc, bucket in found))
            if words:
                n, total = np.concatenate(features), np.concatenate(sums).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(words)), pa.array(n), pa.array(total // np.maximum(n, 1))], [key, "n_words", "n_features", "weight"])

    return df.select(key, F.col(text).cast("binary").alias("_text")).mapInArrow(run, f"`{key}` {kind}, n_words long, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise from the first 32 bits of a SHA-256 of seed and key, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def draw(scored: DataFrame, key: str, percent: int = 10, least_words: int = 20) -> DataFrame:
    """scored: ``key``, n_words, n_features, weight, score. Adds rank: 1, 2, 3 ... of the rows drawn, else null.

    ``scored`` is read twice and must give the same rows each time (a written table)."""
    may = F.col("n_words") >= least_words
    histogram = scored.filter(may).groupBy("score").agg(F.count("*").alias("rows"))
    # gains and noise are logarithms of bounded numbers: at most about 200,000 scores, whatever the corpus
    upward = Window.orderBy(F.col("score").desc())
    running = histogram.withColumn("_before", F.sum("rows").over(upward) - F.col("rows"))
    last = F.expr(f"(sum(rows) over () * {percent}) div 100")
    firsts = durable(running.withColumn("_last", last).filter("_before < _last").select("score", "_before", "_last"), "draw-firsts")
    lowest = firsts.agg(F.min("score")).first()[0]
    drawn = may & (F.col("score") >= lowest) if lowest is not None else F.lit(False)
    # a repeated row is one row with a number of copies until it has its ranks
    rows = scored.filter(drawn).groupBy(*scored.columns).agg(F.count("*").alias("_copies"))
    within = Window.partitionBy("score").orderBy(F.col(key).asc_nulls_last(), "n_features", "n_words")
    ranked = rows.join(F.broadcast(firsts), "score").withColumn("_before", F.col("_before") + F.sum("_copies").over(within) - F.col("_copies"))
    dealt = ranked.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1, F.lit(CHUNK))))
    # copies go to other tasks before they are rows again
    each = F.sequence(F.col("_part") + 1, F.least(F.col("_part") + CHUNK, F.col("_copies")))
    single = dealt.repartition(F.col("_before"), F.col("_part")).withColumn("_copy", F.explode(each)).withColumn("rank", F.col("_before") + F.col("_copy"))
    ranks = single.select(*scored.columns, F.when(F.col("rank") <= F.col("_last"), F.col("rank")).alias("rank"))
    return ranks.unionByName(scored.filter(~drawn).withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024,
) -> DataFrame:
    """``key``, n_words, n_features, weight, score and rank of every document; rank is null where it isn't drawn.

    The driver holds two counts for each of ``buckets``, no more."""
    counts = []
    for df, column in ((docs, text), (target, target_text)):
        count = np.zeros(buckets, np.int64)
        for bucket, n in bucket_counts(df, column, longest, buckets).collect():
            count[bucket] = n
        counts.append(count)
    weighed = weigh(docs, gains(*counts), key, text, longest)
    return draw(durable(weighed.withColumn("score", F.col("weight") + noise(F.col(key), seed)), "resample-scores"), key, percent, least_words)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all documents of 20 words at least, drawn towards the words of benchmark."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_WORD_BYTES = "list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda x: ('0x' || x)::BIGINT)"
_BUCKET = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {_WORD_BYTES}), lambda c, x: xor(c >> 8, list_extract(crc_table, xor(c & 255, x) + 1))), 4294967295) % 10000"

ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_SPLIT} AS words FROM documents),
dw AS (SELECT row, unnest(words) AS word FROM d),
tw AS (SELECT unnest({_SPLIT}) AS word FROM benchmark),
hashed AS (SELECT word, {_BUCKET} AS bucket FROM (SELECT DISTINCT word, {sharding._CRC_TABLE}::BIGINT[] AS crc_table FROM (SELECT word FROM dw UNION ALL SELECT word FROM tw))),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM tw JOIN hashed USING (word) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM tw) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
weighed AS (SELECT row, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY row),
scored AS (SELECT row, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
    FROM d LEFT JOIN weighed USING (row)),
ranked AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (row)
"""
