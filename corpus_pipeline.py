"""From raw documents to token ids: language, exact and near duplicates, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the last return the columns of
documents. Between stages the rows are written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graintable.durable import durable
from graintable.llm import bpe, exact_dedup, language, minhash, mixing


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or whose language isn't found with a score of 0.5, go. Equal texts stand or fall together."""
    return language.keep_identified(docs, language.train(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, that with the smallest doc_id: null texts equal empty ones, null ids come last, and of rows that repeat id and text one is left. An empty table stays empty."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of their five-word shingles the smallest doc_id stays, null ids last; of rows that repeat id and text one is left.

    Documents without a word are linked with nothing and stay. An empty table stays empty."""
    return minhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights: a document stays, goes, or is repeated once. A null source is a source; rows that repeat id and text are taken alike."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded text, and the ids."""
    return bpe.encode_decode(docs, bpe.default_path(), ids=True)


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Neither the language model nor BPE can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
