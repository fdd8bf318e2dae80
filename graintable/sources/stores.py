"""Tables that jobs keep: chunks, the BM25 index and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..durable import durable
from ..operators.corpus import detect_changes, source_fingerprints, split_documents
from ..schemas import CHUNK

PARTS = 16  # files that the chunks of one source are dealt to


def write_corpus(chunks: DataFrame, path: str, fingerprint: str | None = None, known: str | None = None) -> bool:
    """Write chunks by source, unless their fingerprint is the one already stored. Says whether it wrote."""
    if fingerprint is not None and fingerprint == known:
        return False
    _by_source(chunks).parquet(path)
    return True


def _by_source(chunks: DataFrame) -> DataFrameWriter:
    return chunks.withColumn("source", F.col("metadata.source")).repartition("source", F.pmod("doc_id", F.lit(PARTS))).write.mode("overwrite").partitionBy("source")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*CHUNK.names)


def rebuild_corpus(files: DataFrame, path: str, last: int = 0, force: bool = False) -> DataFrame:
    """files: source, text and, if they are there, path and suffix. Chunks again only the sources that are new or changed since rebuild number ``last`` (0: there is none) of ``path``; gives source and change of all.

    A null or empty source is called unknown. Chunks lie under ``path``/chunks, by the rebuild that made them and source. Each rebuild keeps the sources' fingerprints
    and by which rebuild each was chunked, under its number, written last: a rebuild that fails is done again with the same ``last``. ``read_rebuilt`` reads a
    source's chunks of that one rebuild, so what a source had before, or had before it was removed, is passed over, also where nothing took its place.
    """
    spark = files.sparkSession
    named = files.withColumn("source", F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")))
    now = durable(source_fingerprints(named.withColumn("meta", F.col("path") if "path" in files.columns else F.lit("")), content="text"), "fingerprints")
    old = spark.read.parquet(f"{path}/fingerprints-{last}") if last else now.limit(0).withColumn("built", F.lit(0))
    changes = durable(detect_changes(old.drop("built"), now, force), "changes")
    wanted = changes.filter("change IN ('added', 'changed')").select("source")
    chunks = split_documents(named.join(wanted, "source", "left_semi"))
    _by_source(chunks).parquet(f"{path}/chunks/rebuild={last + 1}")
    built = now.join(wanted.withColumn("_new", F.lit(last + 1)), "source", "left").join(old.select("source", F.col("built").alias("_old")), "source", "left")
    built.withColumn("built", F.coalesce("_new", "_old")).drop("_new", "_old").write.mode("overwrite").parquet(f"{path}/fingerprints-{last + 1}")
    return changes


def read_rebuilt(spark: SparkSession, path: str, last: int) -> DataFrame:
    """The chunks of the sources that rebuild number ``last`` found."""
    chunks = spark.read.schema(StructType([*CHUNK.fields, StructField("rebuild", IntegerType()), StructField("source", StringType())])).parquet(f"{path}/chunks")
    present = spark.read.parquet(f"{path}/fingerprints-{last}").select("source", F.col("built").alias("rebuild"))
    return chunks.join(present, ["source", "rebuild"], "left_semi").select(*CHUNK.names)


def write_bm25_index(index: dict[str, DataFrame], path: str, parts: int = 64) -> None:
    """postings and terms by a hash of the term, so that a search reads the parts of its terms; documents and totals as they are."""
    for name, table in index.items():
        if "term" in table.columns:
            table = table.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"))
            # rebalanced, not repartitioned: a large part is written by several tasks
            table.hint("rebalance", "part").sortWithinPartitions("term").write.mode("overwrite").partitionBy("part").parquet(f"{path}/{name}")
        else:
            table.write.mode("overwrite").parquet(f"{path}/{name}")


def read_bm25_index(spark: SparkSession, path: str, blocks: bool = False) -> dict[str, DataFrame]:
    """The tables as written; postings and terms keep part, by which a search prunes what it reads. ``blocks``: those of a packed index, too."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("postings", "documents", "terms", "totals", *["blocks"] * blocks)}


def write_vectors(vectors: DataFrame, path: str, drop_old: bool = True) -> None:
    """Vectors by their cell, if they have one, replacing the old collection or added to it."""
    writer = vectors.write.mode("overwrite" if drop_old else "append")
    if "cell" in vectors.columns:
        writer = vectors.repartition("cell").write.mode("overwrite" if drop_old else "append").partitionBy("cell")
    writer.parquet(path)
