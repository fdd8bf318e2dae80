"""From texts to chunks, and what tells whether chunks changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.html import html_to_markdown
from ..functions.splitting import DEFAULT_SEPARATORS, MARKDOWN_SEPARATORS, split_column

# fixed values: what marks a page of contents, and the line ends that count
TOC = "." * 14
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
TABLE_LINE = r"(?U)^\s*\|.*\|\s*$"
STRIP = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, STRIP, "")


def clean_page_text(pages: DataFrame) -> DataFrame:
    """pages: source, page_no, text. One text a source: pages without their numbers, contents pages or near-empty pages, joined in order, without line ends. A source is one file, whose text must fit in a value."""
    lines = F.transform(F.split(strip(F.col("text")), "\n"), strip)
    page = F.regexp_replace(F.array_join(lines, "\n"), r"(?U)\n\d{2,3}\s?", "\n")
    kept = pages.select("source", "page_no", page.alias("text")).filter((F.length("text") > 10) & ~F.col("text").contains(TOC))
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    joined = kept.groupBy("source").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "").alias("text"))
    return joined.select("source", F.replace("text", F.lit("\n"), F.lit("")).alias("text"))


def sliding_window_chunks(texts: DataFrame, key: str, size: int = 256, overlap: int = 100, least: int = 10) -> DataFrame:
    """Windows of ``size`` characters, each starting size - overlap behind the last, while it starts inside the text; those of at most ``least`` characters are dropped."""
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(size - overlap))
    cut = texts.filter(F.length("text") > 0).select(key, "text", F.explode(starts).alias("start"))
    return cut.select(key, "start", F.substring("text", F.col("start") + 1, F.lit(size)).alias("chunk")).filter(F.length("chunk") > least)


def recursive_chunks(texts: DataFrame, key: str, size: int = 500, overlap: int = 50, separators=DEFAULT_SEPARATORS) -> DataFrame:
    """key, pos (from 0) and chunk."""
    return texts.select(key, F.posexplode(split_column(F.col("text"), size, overlap, separators)).alias("pos", "chunk"))


def table_aware_chunks(texts: DataFrame, key: str, size: int = 500, overlap: int = 100) -> DataFrame:
    """key, chunk_id (from 1, over text and table chunks), type and page_content.

    A run of table lines is one chunk, with the nearest line before and after that isn't blank and has no bar as its context; what lies
    between is split recursively. Lines stay with their document, so one shuffle by document serves all windows.
    """
    lines = texts.select(key, F.posexplode(F.split("text", LINE_ENDS)).alias("pos", "line"))
    by_doc = Window.partitionBy(key).orderBy("pos")
    is_table = F.col("line").rlike(TABLE_LINE)
    plain = F.when((strip(F.col("line")) != "") & ~F.col("line").contains("|"), strip(F.col("line")))
    before = by_doc.rowsBetween(Window.unboundedPreceding, -1)
    after = by_doc.rowsBetween(1, Window.unboundedFollowing)
    marked = lines.withColumn("table", is_table).withColumn("plain", plain).withColumn("prev", F.last("plain", ignorenulls=True).over(before)).withColumn("next", F.first("plain", ignorenulls=True).over(after))
    marked = marked.withColumn("new", F.coalesce((F.col("table") != F.lag("table").over(by_doc)).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(by_doc))
    run = marked.groupBy(key, "run").agg(
        F.first("table").alias("table"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("body"),
        F.min(F.struct("pos", "prev")).alias("first"), F.max(F.struct("pos", "next")).alias("last"),
    )
    context = F.concat_ws("\n", "first.prev", "body", "last.next")
    pieces = F.when(F.col("table"), F.array(context)).otherwise(split_column(strip(F.when(F.col("table"), "").otherwise(F.col("body"))), size, overlap, MARKDOWN_SEPARATORS))
    chunks = run.select(key, "run", F.when(F.col("table"), "table").otherwise("text").alias("type"), F.posexplode(pieces).alias("part", "page_content"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("run", "part"))
    return chunks.select(key, number.alias("chunk_id"), "type", "page_content")


def table_aware_documents(files: DataFrame) -> DataFrame:
    """files: source, text and, if there is one, path. Chunk rows with metadata; a missing source is called unknown.

    Every row is a file of its own, whatever its name. doc_id is a hash of path (or else source), text and chunk_id.
    """
    place = F.coalesce(F.col("path"), F.col("source")) if "path" in files.columns else F.col("source")
    own = F.struct(F.monotonically_increasing_id().alias("row"), F.xxhash64(place, "text").alias("h"), F.coalesce("source", F.lit("unknown")).alias("source"))
    chunks = table_aware_chunks(files.select(own.alias("file"), "text"), "file")
    return chunks.select(F.xxhash64("file.h", "chunk_id").alias("doc_id"), "page_content", F.struct("type", F.col("chunk_id").cast("int").alias("chunk_id"), "file.source").alias("metadata"))


def split_documents(files: DataFrame) -> DataFrame:
    """files: source, text and, if they are there, path and suffix (else that of the source's name). Chunk rows as of ``table_aware_documents``: text files
    (suffix txt) are split recursively, all others with their tables kept whole."""
    suffix = F.col("suffix") if "suffix" in files.columns else F.regexp_extract("source", r"\.([^./]+)$", 1)
    plain = F.coalesce(F.lower(suffix) == "txt", F.lit(False))
    place = F.coalesce(F.col("path"), F.col("source")) if "path" in files.columns else F.col("source")
    texts = files.filter(plain)
    pieces = texts.select(F.xxhash64(place, "text").alias("h"), F.coalesce("source", F.lit("unknown")).alias("source"), F.posexplode(split_column(F.col("text"), 500, 50, DEFAULT_SEPARATORS)).alias("pos", "page_content"))
    number = (F.col("pos") + 1).cast("int").alias("chunk_id")
    recursive = pieces.select(F.xxhash64("h", number.cast("long")).alias("doc_id"), "page_content", F.struct(F.lit("text").alias("type"), number, "source").alias("metadata"))
    return table_aware_documents(files.filter(~plain)).unionByName(recursive)


def process_uploads(files: DataFrame) -> DataFrame:
    """files: filename, text. Per file: status, the name it is stored under and its Markdown; an unusable name is an error of that file alone."""
    base = F.element_at(F.split(F.replace("filename", F.lit("\\"), F.lit("/")), "/"), -1)
    bad = F.col("filename").isNull() | F.col("filename").contains("..") | (base == "")
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    unique = F.substring(F.sha2(F.concat_ws("\u0001", "filename", "text"), 256), 1, 8)
    text = F.array_join(split_column(F.col("text"), 500, 100, MARKDOWN_SEPARATORS), "\n")
    stored = F.when(~bad, F.concat(stem, F.lit("_"), unique, F.lit(".md")))
    return files.select(
        "filename", F.when(bad, "error").otherwise("success").alias("status"), stored.alias("stored_name"),
        F.when(~bad, html_to_markdown(text)).alias("markdown"), F.when(bad, "unusable file name").alias("message"),
    )


def corpus_fingerprint(chunks: DataFrame, source: str = "source", content: str = "page_content", meta: str = "meta") -> DataFrame:
    """One row: a hash of all chunks, whatever their order. Chunks are hashed within their source first, so no task sees all texts."""
    by_source = source_fingerprints(chunks, source, content, meta)
    return by_source.agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", source, "fingerprint"))), "")).alias("fingerprint"))


def source_fingerprints(chunks: DataFrame, source: str = "source", content: str = "page_content", meta: str = "meta") -> DataFrame:
    """source, fingerprint and chunks. A source's chunks are hashed by 65,536 buckets of their hash, these by 256 buckets, and these together, so that a list holds one in 65,536 of a source's hashes."""
    row = chunks.select(source, F.md5(F.concat_ws(":", content, meta)).alias("h"))
    leaf = row.groupBy(source, F.substring("h", 1, 4).alias("p")).agg(F.md5(F.array_join(F.array_sort(F.collect_list("h")), "")).alias("h"), F.count(F.lit(1)).alias("n"))
    joined = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), "")).alias("h")
    part = leaf.groupBy(source, F.substring("p", 1, 2).alias("q")).agg(joined, F.sum("n").alias("n")).withColumnRenamed("q", "p")
    return part.groupBy(source).agg(joined.alias("fingerprint"), F.sum("n").alias("chunks"))


SUMS = [f"s{i}" for i in range(8)]


def multiset_sums(chunks: DataFrame, source: str = "source", content: str = "page_content", meta: str = "meta") -> DataFrame:
    """source, chunks and s0 to s7: the 256 bits of every chunk's hash as eight numbers, summed. Sums don't depend on order, are combined before any
    shuffle, and can be added to and taken from (``updated_sums``); repeated chunks count each time. Nulls differ from empty texts."""
    parts = [x for c in (content, meta) for x in (F.coalesce(F.length(c), F.lit(-1)).cast("string"), F.coalesce(F.col(c), F.lit("")))]
    row = chunks.select(source, F.sha2(F.concat_ws(":", *parts), 256).alias("_h"))
    word = lambda i: F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")
    return row.groupBy(source).agg(F.count(F.lit(1)).alias("chunks"), *[F.sum(word(i)).cast("decimal(38,0)").alias(name) for i, name in enumerate(SUMS)])


def updated_sums(old: DataFrame, added: DataFrame, removed: DataFrame, source: str = "source", content: str = "page_content", meta: str = "meta") -> DataFrame:
    """old: of ``multiset_sums``. The sums after some chunks came and some went, from these alone; a changed chunk is removed and added. Sources without chunks are left out."""
    gone = multiset_sums(removed, source, content, meta).select(source, *[(-F.col(c)).alias(c) for c in ("chunks", *SUMS)])
    every = old.select(source, "chunks", *SUMS).unionByName(multiset_sums(added, source, content, meta)).unionByName(gone)
    return every.groupBy(source).agg(*[F.sum(c).cast("long" if c == "chunks" else "decimal(38,0)").alias(c) for c in ("chunks", *SUMS)]).filter("chunks <> 0")


def sums_fingerprint(sums: DataFrame, source: str = "source") -> DataFrame:
    """source, fingerprint and chunks, as ``detect_changes`` takes them."""
    return sums.select(source, F.concat_ws("-", *[F.col(c).cast("string") for c in SUMS]).alias("fingerprint"), "chunks")


def detect_changes(old: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """Both: source, fingerprint. source and change: added, removed, changed or same (changed, if forced)."""
    joined = old.select("source", F.col("fingerprint").alias("was")).join(new.select("source", F.col("fingerprint").alias("now")), "source", "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when((F.col("was") != F.col("now")) | F.lit(force), "changed").otherwise("same")
    return joined.select("source", change.alias("change"))


def changed_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """The sources whose chunks are to be made again."""
    return detect_changes(old, new).filter("change IN ('added', 'changed')").select("source")


def validate_corpus(chunks: DataFrame, directories: int, content: str = "page_content") -> DataFrame:
    """One row: n_chunks, n_missing (chunks without content), valid and reason."""
    counted = chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col(content).isNull()).alias("n_missing"))
    reason = F.when(F.col("n_chunks") == 0, "empty").when(F.col("n_missing") > 0, "chunks without content").when(F.col("n_chunks") < 0.5 * directories, "too few chunks")
    return counted.select("n_chunks", "n_missing", reason.isNull().alias("valid"), reason.alias("reason"))


def index_alignment(corpus: DataFrame, index: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: rows of the corpus that the index lacks, rows of the index that the corpus lacks, aligned."""
    both = corpus.select(key).distinct().withColumn("c", F.lit(1)).join(index.select(key).distinct().withColumn("i", F.lit(1)), key, "full")
    counted = both.agg(F.count_if(F.col("i").isNull()).alias("missing"), F.count_if(F.col("c").isNull()).alias("orphaned"))
    return counted.select("missing", "orphaned", ((F.col("missing") == 0) & (F.col("orphaned") == 0)).alias("aligned"))
