"""Queries over files and stores that are written from the tables and read again, with the same in SQL for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import shared_dir
from ..operators import bm25
from ..sources import files, segments, stores
from ..sources import price_pages as pages
from ..sources.prices import PRICE_SQL, price_records
from .corpus_queries import SEARCH_SQL

QUERIES = {}
ORACLES = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _new(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


@query("SELECT source, (sum(length(text)) + count(*))::BIGINT AS characters FROM documents GROUP BY 1")
def read_corpus_folder(spark, d):
    """The texts of each source as one file in a folder of its name, a line end behind each."""
    path = _new(spark, "folder")
    _docs(spark, d).select("source", F.concat("text", F.lit("\n")).alias("text")).repartition("source").write.partitionBy("source").option("lineSep", "\u0001").text(path)
    read = files.read_corpus_folder(spark, path)
    text = F.replace("text", F.lit("\u0001"), F.lit(""))
    return read.select(F.regexp_extract("path", "/source=([^/]+)/", 1).alias("source"), F.length(text).alias("n")).groupBy("source").agg(F.sum("n").alias("characters"))


@query(r"SELECT item_id::VARCHAR AS pid, regexp_replace(text, '[\t\r\n]+', ' ', 'g') AS passage FROM benchmark")
def read_passages_tsv(spark, d):
    """The benchmark as a TSV."""
    path = _new(spark, "passages")
    passage = F.regexp_replace("text", r"[\t\r\n]+", " ")
    spark.read.parquet(f"{d}/benchmark.parquet").select(F.concat_ws("\t", "item_id", passage)).write.text(path)
    return files.read_passages_tsv(spark, path)


@query(r"SELECT passage, count(*) AS n FROM (SELECT regexp_replace(unnest(regexp_split_to_array(text, '\r\n|\r|\n')), '^\s+|\s+$', '', 'g') AS passage FROM documents) WHERE passage <> '' GROUP BY 1")
def read_passage_lines(spark, d):
    """The lines of all documents, with their number."""
    path = _new(spark, "lines")
    _docs(spark, d).select("text").write.text(path)
    return files.read_passage_lines(spark, path).groupBy("passage").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, text AS page_content, 'text' AS type, 1 AS chunk_id, source FROM documents")
def write_corpus(spark, d):
    """Documents as chunks, stored by source and read again."""
    path = _new(spark, "corpus")
    metadata = F.struct(F.lit("text").alias("type"), F.lit(1).alias("chunk_id"), "source")
    stores.write_corpus(_docs(spark, d).select("doc_id", F.col("text").alias("page_content"), metadata.alias("metadata")), path)
    return stores.read_corpus(spark, path).select("doc_id", "page_content", "metadata.type", "metadata.chunk_id", "metadata.source")


@query(
    """WITH old AS (SELECT source, count(*) AS n, sum(doc_id) AS s FROM documents WHERE source <> 'src3' AND NOT (source = 'src5' AND doc_id % 2 = 0) GROUP BY 1), new AS (SELECT source, count(*) AS n, sum(doc_id) AS s FROM documents WHERE source <> 'src7' GROUP BY 1)
SELECT coalesce(o.source, n.source) AS source, CASE WHEN o.source IS NULL THEN 'added' WHEN n.source IS NULL THEN 'removed' WHEN o.n <> n.n OR o.s <> n.s THEN 'changed' ELSE 'same' END AS change, coalesce(n.n, 0)::BIGINT AS files FROM old o FULL JOIN new n ON o.source = n.source"""
)
def rebuild_corpus(spark, d):
    """Two rebuilds over two states of the corpus: what the second found, and of how many files each source has chunks after it."""
    path = _new(spark, "rebuilt")
    docs = _docs(spark, d).select(F.col("doc_id").cast("string").alias("path"), "source", "doc_id", F.concat(F.lit("file "), "doc_id", F.lit("\n"), "text").alias("text"))
    stores.rebuild_corpus(docs.filter("source <> 'src3' AND NOT (source = 'src5' AND doc_id % 2 = 0)"), path)
    changes = stores.rebuild_corpus(docs.filter("source <> 'src7'"), path, 1)
    # every file begins with a line of its own, so its first chunk tells it apart
    first = stores.read_rebuilt(spark, path, 2).filter("metadata.chunk_id = 1").groupBy(F.col("metadata.source").alias("source")).agg(F.count(F.lit(1)).alias("files"))
    return changes.join(first, "source", "left").select("source", "change", F.coalesce("files", F.lit(0)).cast("long").alias("files"))


@query(f"WITH {SEARCH_SQL} SELECT query_id, doc_id, round(score, 4) AS score, rank FROM hits WHERE rank <= 20")
def write_bm25_index(spark, d):
    """The index stored in parts and searched from there."""
    path = _new(spark, "index")
    stores.write_bm25_index(bm25.build_index(_docs(spark, d).select("doc_id", bm25.tokenize(F.col("text")).alias("tokens"))), path)
    asked = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), bm25.tokenize(F.col("text")).alias("tokens"))
    return bm25.search(asked, stores.read_bm25_index(spark, path), 20).withColumn("score", F.round("score", 4))


@query(f"WITH {SEARCH_SQL} SELECT query_id, doc_id, round(score, 4) AS score, rank FROM hits WHERE rank <= 20")
def update_bm25_index(spark, d):
    """An index of an older state (a third of the documents missing, a tenth with other texts, some that are gone) brought up to date, its segments merged, and searched."""
    path = _new(spark, "segments")
    tokens = _docs(spark, d).select("doc_id", bm25.tokenize(F.col("text")).alias("tokens"))
    other, missing = F.col("doc_id") % 10 == 1, F.col("doc_id") % 3 == 0
    gone = tokens.filter("doc_id % 7 = 0").select((-1 - F.col("doc_id")).alias("doc_id"), "tokens")
    old = tokens.filter(~missing).withColumn("tokens", F.when(other, F.slice("tokens", 1, 5)).otherwise(F.col("tokens")))
    first = segments.update_index(old.unionByName(gone), path)
    second = segments.update_index(tokens.filter(missing | other), path, gone.select("doc_id"), first)
    last = segments.merge_segments(spark, path, second, segments.segments_of(spark, path, second))
    asked = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), bm25.tokenize(F.col("text")).alias("tokens"))
    return bm25.search(asked, segments.open_index(spark, path, last), 20).withColumn("score", F.round("score", 4))


@query("SELECT vec_id, label::INTEGER AS cell, len(embedding)::INTEGER AS dims, round(embedding[64]::DOUBLE, 5) AS last FROM embeddings")
def write_vectors(spark, d):
    """Vectors stored by label, twice, the second time in place of the first."""
    path = _new(spark, "vectors")
    v = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding", F.col("label").cast("int").alias("cell"))
    stores.write_vectors(v, path)
    stores.write_vectors(v, path)
    return spark.read.parquet(path).select("vec_id", "cell", F.size("embedding").alias("dims"), F.round(F.element_at("embedding", 64).cast("double"), 5).alias("last"))


@query(f"""WITH {PRICE_SQL} SELECT channel, record_id, materialName, materialModelSpec, price, unit, province, city, releaseDate, brand FROM price_records
WHERE channel IN ('information_price', 'zc_price') AND releaseDate >= '1995-01-01' AND releaseDate < '1997-07-01' AND price >= 500 AND length(materialName) % 2 = 0""")
def price_pages(spark, d):
    """All records as pages of responses; those of two channels, within dates and above a price, are read back. The test of the name's length is left to Spark."""
    path = _new(spark, "channel")
    pages.write_price_pages(price_records(spark, d), path)
    met = F.col("channel").isin("information_price", "zc_price") & F.col("releaseDate").between("1995-01-01", "1997-06-30") & (F.col("price") >= 500)
    found = pages.fetch_prices(spark, path, met, F.length("materialName") % 2 == 0)
    return found.select("channel", "record_id", "materialName", "materialModelSpec", "price", "unit", "province", "city", "releaseDate", "brand")
