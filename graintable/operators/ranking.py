"""Merging, reranking and presenting search results."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from math import sqrt

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Scorer = Callable[[Sequence[str], Sequence[str]], Sequence[float]]
LEAST_DOCS, MOST_DOCS, DEFAULT_DOCS = 1, 50, 10


def hybrid_merge(results: DataFrame, methods: Sequence[str] = ("bm25",)) -> DataFrame:
    """results: query_id, method, rank, page_content and more. One list a query: the methods in their order, each passage once, at its first place."""
    position = F.array_position(F.array(*[F.lit(m) for m in methods]), F.col("method"))
    used = results.filter(F.col("method").isin(*methods)).withColumn("_p", position)
    once = F.row_number().over(Window.partitionBy("query_id", F.xxhash64("page_content"), "page_content").orderBy("_p", "rank"))
    kept = used.withColumn("_n", once).filter("_n = 1").drop("_n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_p", "rank"))).drop("_p")


def ngram_cosine() -> Scorer:
    """The default scorer: cosine of the counts of character 2- and 3-grams."""

    def counts(text: str) -> Counter:
        s = " ".join((text or "").lower().split())
        return Counter(s[i : i + n] for n in (2, 3) for i in range(len(s) - n + 1))

    def score(queries: Sequence[str], passages: Sequence[str]) -> list[float]:
        known: dict[str, Counter] = {}
        out = []
        for q, p in zip(queries, passages, strict=True):
            if q not in known:
                if len(known) >= 1000:
                    known.clear()
                known[q] = counts(q)
            a, b = known[q], counts(p)
            norms = sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
            out.append(sum(v * b[g] for g, v in a.items() if g in b) / norms if norms else 0.0)
        return out

    return score


def score_pairs(pairs: DataFrame, make_scorer: Callable[[], Scorer] = ngram_cosine, query: str = "query", passage: str = "page_content", batch: int = 64) -> DataFrame:
    """pairs with rerank_score and ok; a batch the scorer fails on gets 0 and ok false. The scorer is made once a task."""
    names = pairs.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for part in parts:
            scores, ok = [], []
            for at in range(0, len(part), batch):
                some = part.iloc[at : at + batch]
                try:
                    scores += [float(s) for s in scorer(list(some[query].fillna("")), list(some[passage].fillna("")))]
                    ok += [True] * len(some)
                except Exception:
                    scores += [0.0] * len(some)
                    ok += [False] * len(some)
            yield part[names].assign(rerank_score=scores, ok=ok)

    return pairs.mapInPandas(run, T.StructType([*pairs.schema.fields, T.StructField("rerank_score", T.DoubleType()), T.StructField("ok", T.BooleanType())]))


def rerank(candidates: DataFrame, k: int = DEFAULT_DOCS, digits: int = 6, **options) -> DataFrame:
    """candidates: query_id, query, rank, page_content. The k best by score, ties in their old order; a blank query keeps its first k, without scores."""
    blank = F.trim(F.coalesce("query", F.lit(""))) == ""
    scored = score_pairs(candidates, **options).withColumn("rerank_score", F.when(~blank, F.round("rerank_score", digits)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), "rank"))
    return scored.withColumn("rank", place).filter(F.col("rank") <= k)


def build_contexts(ranked: DataFrame) -> DataFrame:
    """query_id, context (the passages by rank, one a line) and n_docs. ranked holds a bounded number of rows a query."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "page_content")))
    return ranked.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["page_content"]), "\n").alias("context"), F.count(F.lit(1)).alias("n_docs"))


def reference_docs(ranked: DataFrame) -> DataFrame:
    """What is shown beside an answer: filename (of passages without a source a numbered title) and context."""
    # fixed value: the title
    title = F.concat(F.lit("文档片段 "), F.col("rank").cast("string"))
    return ranked.select("query_id", "rank", F.coalesce(F.nullif("source", F.lit("")), title).alias("filename"), F.col("page_content").alias("context"))
