"""A BM25 index that is updated, not built again.

An update writes one segment: the postings of new and changed documents, and what the update adds to and takes from the document frequencies,
the number of documents and their length (a sum of such differences over segments is the present value). What became of a changed or removed document in earlier
segments is dead: a small table of (doc_id, upto), where upto is the last segment that is dead for it. Only the documents that an update names are looked up, in the buckets that hold
them; no posting list is read or written again. Small segments are merged into one without their dead postings.

Under ``path``: postings, documents, frequencies, sums by segment, dead by update, and a manifest of the segments in use for each update,
written last: an update that fails is done again with the same ``last``. Null keys are no documents. A document named twice in an update counts with the tokens that sort last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import durable
from ..operators.bm25 import EPSILON, counted, singled

BUCKETS = 64
FEW = 1_000_000  # so many dead documents' ids are sent to all tasks


def _bucket(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int"))


def segments_of(spark: SparkSession, path: str, last: int) -> list[int]:
    """The numbers of the segments in use after update ``last``."""
    return sorted(r["segment"] for r in spark.read.parquet(f"{path}/manifests/{last}").collect()) if last else []


def _read(spark: SparkSession, path: str, name: str, segments: list[int], schema: str) -> DataFrame:
    """Rows of some segments; their number is a partition, so others aren't listed as tasks."""
    if not segments:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{name}").filter(F.col("segment").isin(segments))


def _dead(spark: SparkSession, path: str, last: int) -> DataFrame:
    schema = "doc_id long, upto int, update int"
    if not last:
        return spark.createDataFrame([], "doc_id long, upto int")
    return spark.read.schema(schema).parquet(f"{path}/dead").filter(F.col("update") <= last).groupBy("doc_id").agg(F.max("upto").alias("upto"))


def _dead_in(spark: SparkSession, path: str, last: int, segments: list[int]) -> DataFrame:
    """What is dead in some segments, written; few ids are broadcast, so that the segments' rows aren't shuffled to drop them."""
    dead = durable(_dead(spark, path, last).filter(F.col("upto") >= min(segments, default=0)), "dead")
    return F.broadcast(dead) if dead.count() <= FEW else dead


def _live(rows: DataFrame, dead: DataFrame) -> DataFrame:
    gone = dead.withColumnRenamed("doc_id", "_gone")
    return rows.join(gone, (F.col("doc_id") == F.col("_gone")) & (F.col("segment") <= F.col("upto")), "left_anti")


POSTINGS = "term string, doc_id long, tf long, dl long, lengths array<long>, segment int, part int"
DOCUMENTS = "doc_id long, dl long, terms array<string>, segment int, bucket int"
FREQUENCIES = "term string, df long, segment int, part int"
SUMS = "n long, dl long, segment int"


def _finish(spark: SparkSession, path: str, number: int, segments: list[int]) -> int:
    spark.createDataFrame([(s,) for s in segments], "segment int").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifests/{number}")
    return number


def update_index(tokens: DataFrame, path: str, removed: DataFrame | None = None, last: int = 0) -> int:
    """tokens: doc_id, tokens of new and changed documents. removed: doc_id. The index under ``path`` after update ``last`` (0: there is none) is
    brought up to date by a segment; gives the number of this update."""
    spark, number = tokens.sparkSession, last + 1
    # the lengths of a document named twice are that of the tokens that count
    current = singled(tokens.filter("doc_id is not null"), F.max).withColumn("lengths", F.lit(None).cast("array<long>"))
    named = current.select("doc_id") if removed is None else current.select("doc_id").unionByName(removed.select("doc_id").dropna()).distinct()
    old = _read(spark, path, "documents", segments_of(spark, path, last), DOCUMENTS)
    asked = _bucket(named, "doc_id", "bucket")
    gone = durable(_live(old.join(asked, ["bucket", "doc_id"], "left_semi"), _dead(spark, path, last)).select("doc_id", "dl", "terms"), "segment-gone")

    _write(path, "postings", number, counted(current), "term", "part")
    postings = _read(spark, path, "postings", [number], POSTINGS)
    documents = current.select("doc_id", F.size("tokens").cast("long").alias("dl"), F.array_distinct("tokens").alias("terms"))
    _write(path, "documents", number, documents, "doc_id", "bucket")
    frequencies = postings.select("term", F.lit(1).alias("df")).unionByName(gone.select(F.explode("terms").alias("term"), F.lit(-1).alias("df"))).groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")
    # of the rows as they were written: texts aren't cut into words again for it
    written = _read(spark, path, "documents", [number], DOCUMENTS)
    sums = written.select(F.lit(1).alias("n"), "dl").unionByName(gone.select(F.lit(-1).alias("n"), (-F.col("dl")).alias("dl"))).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl"))
    _write(path, "frequencies", number, frequencies, "term", "part")
    sums.coalesce(1).write.mode("overwrite").parquet(f"{path}/sums/segment={number}")
    gone.select("doc_id", F.lit(last).alias("upto")).write.mode("overwrite").parquet(f"{path}/dead/update={number}")
    return _finish(spark, path, number, [*segments_of(spark, path, last), number])


def _write(path: str, name: str, number: int, table: DataFrame, column: str, by: str) -> None:
    # rebalanced, not repartitioned: a large bucket is written by several tasks. Rows are in the order of their buckets alone, as nothing reads them by words
    _bucket(table, column, by).hint("rebalance", by).sortWithinPartitions(by).write.mode("overwrite").partitionBy(by).parquet(f"{path}/{name}/segment={number}")


def open_index(spark: SparkSession, path: str, last: int) -> dict[str, DataFrame]:
    """The tables of ``bm25.build_index`` as of update ``last``, to be searched by ``bm25.search``; postings and terms keep part, by which reading is pruned."""
    segments = segments_of(spark, path, last)
    dead = _dead_in(spark, path, last, segments)
    postings = _live(_read(spark, path, "postings", segments, POSTINGS), dead).select("term", "doc_id", "tf", "dl", "lengths", "part")
    documents = _live(_read(spark, path, "documents", segments, DOCUMENTS), dead).select("doc_id", "dl")
    counts = _read(spark, path, "sums", segments, SUMS).agg(F.sum("n").alias("n"), (F.sum("dl") / F.sum("n")).alias("avgdl"))
    df = durable(_read(spark, path, "frequencies", segments, FREQUENCIES).groupBy("part", "term").agg(F.sum("df").alias("df")).filter("df > 0"), "index-frequencies")
    raw = df.crossJoin(F.broadcast(counts)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    totals = durable(raw.agg(F.avg("raw").alias("avg_idf")).crossJoin(F.broadcast(counts)).select("n", "avgdl", "avg_idf"), "index-totals")
    terms = raw.drop("n", "avgdl").crossJoin(F.broadcast(totals.select("avg_idf"))).select("part", "term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("avg_idf")).otherwise(F.col("raw")).alias("idf"))
    return {"postings": postings, "documents": documents, "terms": terms, "totals": totals}


def small_segments(spark: SparkSession, path: str, last: int, share: float = 0.1) -> list[int]:
    """The segments with fewer documents than ``share`` of the largest one's."""
    sizes = {r["segment"]: r["n"] for r in _read(spark, path, "documents", segments_of(spark, path, last), DOCUMENTS).groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [s for s in segments_of(spark, path, last) if sizes.get(s, 0) < share * max(sizes.values(), default=0)]


def merge_segments(spark: SparkSession, path: str, last: int, segments: list[int]) -> int:
    """Some segments become one, without what is dead in them; gives the number of this update. Their differences are added up as they are: what they took away was taken from others."""
    number, dead = last + 1, _dead_in(spark, path, last, segments)
    live = lambda name, schema: _live(_read(spark, path, name, segments, schema), dead).drop("segment")
    # rows stay in the part or bucket they are in, so they are written by the tasks that read them
    for name, schema, by in (("postings", POSTINGS, "part"), ("documents", DOCUMENTS, "bucket")):
        live(name, schema).sortWithinPartitions(by).write.mode("overwrite").partitionBy(by).parquet(f"{path}/{name}/segment={number}")
    frequencies = _read(spark, path, "frequencies", segments, FREQUENCIES).groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")
    sums = _read(spark, path, "sums", segments, SUMS).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl"))
    _write(path, "frequencies", number, frequencies, "term", "part")
    sums.coalesce(1).write.mode("overwrite").parquet(f"{path}/sums/segment={number}")
    spark.createDataFrame([], "doc_id long, upto int").coalesce(1).write.mode("overwrite").parquet(f"{path}/dead/update={number}")
    kept = [s for s in segments_of(spark, path, last) if s not in segments]
    return _finish(spark, path, number, [*kept, number])
