"""Substring dedup by sliding sentence spans.

From every sentence the shortest run forward and the shortest run back of at least WIDTH sentences and LEAST_WORDS words is hashed to 128
bits; a sentence of LONG_WORDS is a run by itself. So every sentence of a passage of WIDTH whole sentences and LEAST_WORDS words, however
short they are, lies in a run that doesn't leave the passage. Runs are joined over all documents by their hash; of equal runs the first
one, by key, then place, stays, and the sentences that any other covers are cut out of their documents.

The first shuffle holds only 64 bits of each run and a count, the second the runs by these 64 bits; what isn't repeated ends there.
A run that a third of all documents share is counted before it is shuffled, and its occurrences are split by adaptive execution.
Joins to the texts are made alike at every size. Texts are never cut at a limit; one document is worked on at a time.

Defined cases: a null text stays null, an empty one empty, neither has sentences; rows with equal key and text are at the same place, so none of them
is cut for the other's sake; rows that share a key but not the text are told apart by the text's hash; null keys come first; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import durable

WIDTH, LEAST_WORDS, LONG_WORDS = 2, 16, 25
_END = re.compile(r"[.!?]+[\x20\x09-\x0D]+|[\n\v\f\r]+")


def sentences(text: str) -> list[tuple[int, int, str, int]]:
    """Start, end, text with single blanks, and number of words of every sentence that isn't blank. A sentence ends at . ! or ? before a blank, or with its line."""
    out, at = [], 0
    for match in [*_END.finditer(text), None]:
        end = match.end() if match else len(text)
        words = text[at:end].split()
        if words:
            out.append((at, end, " ".join(words), len(words)))
        at = end
    return out


def runs(text: str | None, width: int = WIDTH, least: int = LEAST_WORDS, long: int = LONG_WORDS) -> Iterator[tuple[int, int, bytes]]:
    """Start, end and 128-bit hash of every run."""
    from xxhash import xxh3_128_digest

    found = sentences(text or "")
    before = [0, *accumulate(s[3] for s in found)]  # words before each sentence
    spans, first, enough = [], 0, False
    for last in range(len(found)):
        next_start = first + enough
        while last - first + 1 > width and before[last + 1] - before[first + 1] >= least:
            first += 1
        enough = last - first + 1 >= width and before[last + 1] - before[first] >= least
        # first has the shortest run back from last; for each start from next_start, this is the shortest run forward
        spans += [(k, last) for k in range(min(next_start, first), first + 1)] if enough else []
    for k, (start, end, own, n) in enumerate(found):
        if n >= long:
            yield start, end, xxh3_128_digest(own.encode("utf-8", "surrogatepass"))
    for k, last in spans:
        yield found[k][0], found[last][1], xxh3_128_digest("\n".join(s[2] for s in found[k : last + 1]).encode("utf-8", "surrogatepass"))


def _runs_table(docs: DataFrame, width: int, least: int, long: int, places: bool) -> DataFrame:
    """docs: id, text. h of every run or, with places, id, t (the text's hash), start, end, h and h2."""
    kind = docs.schema["id"].dataType.simpleString()
    fields = f"h long, h2 long, id {kind}, t long, start int, end int" if places else "h long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, rows = [], []
            for row, text in enumerate(batch.column(1)):
                own = list(runs(text.as_py(), width, least, long))
                spans += own
                rows += [row] * len(own)
            h = np.frombuffer(b"".join(s[2] for s in spans), "<i8").reshape(-1, 2)
            columns = {"h": pa.array(h[:, 0])}
            if places:
                taken = pa.array(rows, pa.int64())
                columns |= {"h2": pa.array(h[:, 1]), "id": batch.column(0).take(taken), "t": batch.column(2).take(taken), "start": pa.array([s[0] for s in spans], pa.int32()), "end": pa.array([s[1] for s in spans], pa.int32())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.select("id", "text", "t").mapInArrow(run, fields)


def repeated_spans(docs: DataFrame, width: int = WIDTH, least: int = LEAST_WORDS, long: int = LONG_WORDS) -> DataFrame:
    """docs: id, text, t. Gives id, t, start and end (in characters) of every run that isn't the first of its kind."""
    common = durable(_runs_table(docs, width, least, long, False).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "repeated")
    found = durable(_runs_table(docs, width, least, long, True).join(common.hint("merge"), "h"), "runs")
    place = F.struct("id", "t", "start")
    first = durable(found.groupBy("h", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "h2", "first"), "first")
    return found.join(first, ["h", "h2"]).filter(place != F.col("first")).select("id", "t", "start", "end")


def cut_repeats(docs: DataFrame, width: int = WIDTH, least: int = LEAST_WORDS, long: int = LONG_WORDS) -> DataFrame:
    """docs: id, text. One row for each row: id, text without repeated sentences, removed_chars and removed_spans (start, end; merged)."""
    docs = docs.select("id", "text", F.xxhash64("text").alias("t"))
    spans = repeated_spans(docs, width, least, long).groupBy(F.col("id").alias("_id"), F.col("t").alias("_t")).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    joined = docs.join(durable(spans, "spans").hint("merge"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t")), "left").select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, cuts = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                merged: list[list[int]] = []
                for start, end in sorted((s["start"], s["end"]) for s in spans or []):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([start, end])
                kept, at = [], 0
                for start, end in merged:
                    kept.append(text[at:start])
                    at = end
                texts.append(text if not merged else "".join(kept) + text[at:])
                sizes.append(sum(e - s for s, e in merged))
                cuts.append([{"start": s, "end": e} for s, e in merged])
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(cuts, span)], ["id", "text", "removed_chars", "removed_spans"])

    kind = docs.schema["id"].dataType.simpleString()
    return joined.mapInArrow(run, f"id {kind}, text string, removed_chars long, removed_spans array<struct<start: int, end: int>>")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their repeated sentences cut out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    return cut_repeats(docs).withColumnRenamed("id", "doc_id")
