"""Language identification from character n-grams.

Features: letters in lower case, everything else a blank, blanks collapsed; n-grams of 1 to 3 characters hashed to 2 ** BITS buckets;
TF-IDF with unit length. Document frequencies cover every training document. The model, a multinomial logistic regression, is trained
on a bounded sample: SAMPLE documents in expectation, evenly by language, chosen by a hash of key and text, of repeated rows one. Training is follow the
regularised leader with per-coordinate steps (McMahan et al., 2013) under an L1 and an L2 penalty, so most weights are zero; a
quarter of the sample is set aside to find the temperature that makes the scores probabilities.

What leaves the executors is of fixed size: the document frequencies (2 ** BITS numbers) and the sample's sparse vectors. Prediction
works on Arrow batches, which Spark bounds by bytes, and takes long texts in pieces, so memory doesn't follow the longest text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text if no training row has a language; if there
is one language only, every text with a letter is in it with score 1; a null key counts as held out; repeated rows are learned from
and judged each; empty tables give empty results. Language, source and key are not inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import HASH_BITS, key_hash

BITS = 15
LONGEST = 3
SAMPLE = 2400  # documents that the weights are fitted on, in all languages together
PIECE = 1 << 20
UNKNOWN = "und"
FOLDS = 5

_codes: list[np.ndarray] = []


def _letter_codes() -> np.ndarray:
    """Of each code point: itself if it is a letter, else 0."""
    if not _codes:
        _codes.append(np.fromiter((c if chr(c).isalpha() else 0 for c in range(0x110000)), np.int64, 0x110000))
    return _codes[0]


def gram_counts(text: str | None) -> np.ndarray | None:
    """How often each bucket's n-grams occur in the whole text; None if it has no letter."""
    buckets, letters, carry = [], False, np.zeros(1, np.int64)
    total = None
    for at in range(0, len(text or ""), PIECE):
        raw = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        x = np.concatenate([carry, _letter_codes()[raw.astype(np.int64)], np.zeros(int(at + PIECE >= len(text)), np.int64)])
        keep = np.ones(len(x), bool)
        keep[1:] = (x[1:] | x[:-1]) != 0
        x = x[keep]
        letters = letters or bool(x.any())
        new = len(carry)  # what ends before it was counted with the last piece
        hashed = x * 0x9E3779B97F4A7C1
        grams = hashed
        for n in range(LONGEST):
            if n:
                grams = grams[:-1] * 0x2545F4914F6CDD1 + hashed[n:]
            buckets.append((grams[max(new - n, 0) :] >> 31) & ((1 << BITS) - 1))
        if at + PIECE < len(text):  # a long text is counted as it goes
            counts = np.bincount(np.concatenate(buckets), minlength=1 << BITS)
            total, buckets = counts if total is None else total + counts, []
            carry = x[-(LONGEST - 1) :]
    if not letters:
        return None
    counts = np.bincount(np.concatenate(buckets), minlength=1 << BITS)
    return counts if total is None else total + counts


@dataclass
class Model:
    """languages, and of each bucket its inverse document frequency times its weights."""

    languages: list[str] = field(default_factory=list)
    idf: np.ndarray | None = None
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None
    temperature: float = 1.0

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = gram_counts(text) if self.languages else None
        if counts is None:
            return UNKNOWN, 0.0
        hit = np.flatnonzero(counts)
        x = counts[hit] * self.idf[hit]
        logits = (counts[hit] @ self.weights[hit] / max(np.sqrt(x @ x), 1e-12) + self.bias) / self.temperature
        p = np.exp(logits - logits.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, size: int, epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> np.ndarray:
    """rows: buckets, values, class. The weights, size + 1 by classes; the last row is the bias, which sees no penalty."""
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))
    penalty = np.full((size + 1, 1), l1)
    penalty[-1] = 0

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= penalty[at], 0.0, -(zs - np.sign(zs) * penalty[at]) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            buckets, values, label = rows[k]
            at, x = np.append(buckets, size), np.append(values, 1.0)
            w = weights(at)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            g = np.outer(x, p)
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    return weights(np.arange(size + 1))


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least mean log loss, by golden section on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        x = logits / np.exp(t)
        x = x - x.max(1, keepdims=True)
        return float((np.log(np.exp(x).sum(1)) - x[np.arange(len(labels)), labels]).mean())

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % FOLDS == 0


def train(docs: DataFrame, key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """docs: ``key``, text, lang. Learns from rows with a language that aren't held out."""
    rows = docs.select(F.col(key).alias("key"), "text", "lang").filter(F.col("lang").isNotNull() & ~held_out(F.col("key")))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    languages = sorted(counts)
    if not languages:
        return Model()

    def frequencies(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for part in parts:
            for text in part["text"]:
                found = gram_counts(text)
                if found is not None:
                    df += found > 0
                    n += 1
        yield pd.DataFrame({"bucket": np.arange(-1, 1 << BITS), "df": np.append(n, df)})

    summed = rows.select("text").mapInPandas(frequencies, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas().set_index("bucket")["df"]
    df = summed.reindex(range(-1, 1 << BITS), fill_value=0).to_numpy()
    idf = np.log((1 + df[0]) / (1 + df[1:])) + 1

    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, sample / len(languages) / counts[lang]))])
    place = key_hash(F.lit("language"), F.col("key"), F.md5(F.coalesce("text", F.lit(""))))
    chosen = rows.withColumn("place", place).filter(F.col("place") < share[F.col("lang")] * float(2**HASH_BITS))
    chosen = chosen.groupBy("place").agg(F.first("lang").alias("lang"), F.first("text").alias("text")).select("lang", "text", key_hash(F.lit("fold"), F.col("place")).alias("h"))

    def vectors(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for lang, text, h in part.itertuples(index=False):
                found = gram_counts(text)
                if found is not None:
                    hit = np.flatnonzero(found)
                    x = found[hit] * idf[hit]
                    out.append((lang, h, hit.astype(np.int32), (x / np.sqrt(x @ x)).astype(np.float32)))
            yield pd.DataFrame(out, columns=["lang", "h", "buckets", "x"])

    got = sorted(chosen.mapInPandas(vectors, "lang string, h long, buckets array<int>, x array<float>").collect(), key=lambda r: (r["h"], r["lang"], len(r["x"])))
    data = [(np.array(r["buckets"], np.int64), np.array(r["x"], np.float64), languages.index(r["lang"]), r["h"] % 4 == 0) for r in got]
    weights = fit_ftrl([x[:3] for x in data if not x[3]], len(languages), 1 << BITS)
    aside = [x for x in data if x[3]]
    logits = np.array([x @ weights[b] + weights[-1] for b, x, _, _ in aside]).reshape(len(aside), len(languages))
    temperature = fit_temperature(logits, np.array([x[2] for x in aside], int))
    return Model(languages, idf.astype(np.float32), (idf[:, None] * weights[:-1]).astype(np.float32), weights[-1], temperature)


def identify(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """``key``, lang_pred and score of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [key, "lang_pred", "score"])

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose language is found with at least that score. A model that knows no language rejects only texts without a letter."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model.languages:
                keep = [model.predict(x.as_py())[1] >= least for x in batch.column(at)]
            else:
                keep = [any(c.isalpha() for c in x.as_py() or "") for x in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by a model learned from four fifths of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(docs, train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
