"""Folders, passage files and the file catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLE_SUFFIXES = ("md", "txt")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def read_corpus_folder(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = TABLE_SUFFIXES) -> DataFrame:
    """Every file of a folder tree with a known suffix: path, source (file name), suffix and text. Other files are never opened."""
    glob = "*.{" + ",".join(suffixes) + "}"
    read = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    path = F.col("_metadata.file_path")
    return read.select(path.alias("path"), file_name(path).alias("source"), F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).alias("suffix"), F.col("value").alias("text"))


def read_passages_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A TSV without header: pid, passage."""
    return spark.read.csv(path, sep="\t", header=False, quote="", schema="pid STRING, passage STRING")


def read_passage_lines(spark: SparkSession, path: str) -> DataFrame:
    """One passage a line, trimmed; blank lines are left out."""
    return trimmed_lines(spark.read.text(path))


def trimmed_lines(lines: DataFrame) -> DataFrame:
    """lines: value. Gives passage."""
    passage = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    return lines.select(passage.alias("passage")).filter(F.length("passage") > 0)


def file_table(spark: SparkSession, folder: str) -> DataFrame:
    """filename, path, size and modified_time of every file of a folder tree; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(file_name(F.col("path")).alias("filename"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified_time"))


def list_files(files: DataFrame) -> DataFrame:
    """The catalogue, newest first: filename, size, size_mb, modified_time."""
    return files.select("filename", "size", F.round(F.col("size") / 2**20, 2).alias("size_mb"), "modified_time").orderBy(F.col("modified_time").desc(), "filename")


def catalogue_totals(files: DataFrame) -> DataFrame:
    """One row: total_count, total_size_mb."""
    return files.agg(F.count(F.lit(1)).alias("total_count"), F.round(F.coalesce(F.sum("size"), F.lit(0)) / 2**20, 2).alias("total_size_mb"))


def delete_status(catalogue: DataFrame, requested: DataFrame) -> DataFrame:
    """requested: filename. The fate of each distinct name: deleted, or failed with a reason. A name that leaves the folder is not allowed."""
    # fixed value: the reason for a missing file
    missing = "文件不存在"
    names = requested.select("filename").distinct()
    found = names.join(catalogue.select("filename").distinct().withColumn("_found", F.lit(True)), "filename", "left")
    outside = F.col("filename").contains("..") | F.col("filename").contains("/") | (F.coalesce("filename", F.lit("")) == "")
    reason = F.when(outside, "not allowed").when(F.col("_found").isNull(), missing)
    return found.select("filename", F.when(reason.isNull(), "deleted").otherwise("failed").alias("status"), reason.alias("reason"))


def survivors(catalogue: DataFrame, requested: DataFrame) -> DataFrame:
    """The catalogue after deletion."""
    gone = delete_status(catalogue, requested).filter("status = 'deleted'")
    return catalogue.join(gone, "filename", "left_anti")


def folder_fingerprint(files: DataFrame) -> DataFrame:
    """One row: MD5 over the sorted ``path:mtime:size`` of all files, first within each directory."""
    entry = F.concat_ws(":", "path", F.unix_micros("modified_time"), "size")
    by_dir = files.groupBy(F.regexp_replace("path", r"/[^/]*$", "").alias("dir")).agg(F.md5(F.array_join(F.array_sort(F.collect_list(entry)), "\n")).alias("h"))
    return by_dir.agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "dir", "h"))), "\n")).alias("fingerprint"))


def read_turns_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Dialogue turns as they arrive as JSON files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)
