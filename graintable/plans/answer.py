"""Answering questions from a corpus: search, merge, rerank, context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bm25, ranking


def answer_retrieval(questions: DataFrame, corpus: DataFrame, index: dict[str, DataFrame], num_docs: int = ranking.DEFAULT_DOCS, candidates: int = 20) -> DataFrame:
    """questions: query_id, query. corpus: doc_id, page_content. query_id, success, message, context and n_docs of every question; one without a hit is a row with success false."""
    if not ranking.LEAST_DOCS <= num_docs <= ranking.MOST_DOCS:
        raise ValueError(f"num_docs must be {ranking.LEAST_DOCS} to {ranking.MOST_DOCS}")
    hits = bm25.search(questions.select("query_id", bm25.tokenize(F.col("query")).alias("tokens")), index, candidates)
    found = hits.join(corpus.select("doc_id", "page_content"), "doc_id").withColumn("method", F.lit("bm25"))
    merged = ranking.hybrid_merge(found).join(questions.select("query_id", "query"), "query_id")
    ranked = ranking.rerank(merged.select("query_id", "query", "doc_id", "rank", "page_content"), num_docs)
    contexts = ranking.build_contexts(ranked)
    out = questions.select("query_id").join(contexts, "query_id", "left")
    ok = F.col("context").isNotNull()
    return out.select("query_id", ok.alias("success"), F.when(ok, "ok").otherwise("nothing found").alias("message"), "context", F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"))
