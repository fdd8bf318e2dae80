"""Queries over documents, pages and vectors, with the same in SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import segment
from ..functions.html import html_to_markdown as to_markdown
from ..operators import blockmax, bm25, corpus, ranking, vector_index, vectors
from ..sources import files
from .answer import answer_retrieval as answer

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", "source", F.col("text").alias("page_content"), F.col("lang").alias("meta"))


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query(
    f"""WITH paged AS (SELECT source, doc_id, array_to_string(list_transform(string_split({STRIP.format('text')}, chr(10)), lambda l: {STRIP.format('l')}), chr(10)) AS t FROM documents),
kept AS (SELECT source, doc_id, regexp_replace(t, '\\n\\d{{2,3}}\\s?', chr(10), 'g') AS t FROM paged)
SELECT source, replace(string_agg(t, '' ORDER BY doc_id), chr(10), '') AS text FROM kept WHERE length(t) > 10 AND NOT contains(t, '..............') GROUP BY source"""
)
def clean_page_text(spark, d):
    """Documents as the pages of their source."""
    return corpus.clean_page_text(_docs(spark, d).select("source", F.col("doc_id").alias("page_no"), "text"))


@query("SELECT doc_id, s::INTEGER AS start, substr(text, s::INTEGER + 1, 256) AS chunk FROM (SELECT doc_id, text, unnest(range(0, length(text), 156)) AS s FROM documents WHERE length(text) > 0) WHERE length(substr(text, s::INTEGER + 1, 256)) > 10")
def sliding_window_chunks(spark, d):
    return corpus.sliding_window_chunks(_docs(spark, d), "doc_id")


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files in a directory for each source."""
    name = F.concat(F.lit("doc-"), "doc_id")
    return _docs(spark, d).select(name.alias("filename"), F.concat(F.lit("/corpus/"), "source", F.lit("/"), name).alias("path"), F.octet_length("text").cast("long").alias("size"), F.timestamp_micros(F.col("doc_id") * 61_000_003 % 7_000_000_000_000).alias("modified_time"))


CATALOGUE_SQL = "files AS (SELECT 'doc-' || doc_id AS filename, '/corpus/' || source || '/doc-' || doc_id AS path, '/corpus/' || source AS dir, strlen(text) AS size, doc_id * 61000003 % 7000000000000 AS us FROM documents)"


@query(f"WITH {CATALOGUE_SQL} SELECT filename, size, round(size / 1048576, 2) AS size_mb, us AS modified_us FROM files")
def list_files(spark, d):
    return files.list_files(_catalogue(spark, d)).select("filename", "size", "size_mb", F.unix_micros("modified_time").alias("modified_us"))


@query(f"WITH {CATALOGUE_SQL}, dirs AS (SELECT dir, md5(string_agg(path || ':' || us || ':' || size, chr(10) ORDER BY path || ':' || us || ':' || size)) AS h FROM files GROUP BY 1) SELECT md5(string_agg(dir || ':' || h, chr(10) ORDER BY dir || ':' || h)) AS fingerprint FROM dirs")
def folder_fingerprint(spark, d):
    return files.folder_fingerprint(_catalogue(spark, d))


@query()
def recursive_split(spark, d):
    return corpus.recursive_chunks(_docs(spark, d).select("doc_id", "text"), "doc_id")


@query()
def table_aware_documents(spark, d):
    """Documents with a table of their first words in the middle."""
    words = F.split("text", " ")
    table = F.concat(F.lit("\n| "), F.array_join(F.slice(words, 1, 3), " | "), F.lit(" |\n|---|---|---|\n"))
    half = (F.length("text") / 2).cast("int")
    text = F.concat(F.substring("text", F.lit(1), half), table, F.substring("text", half + 1, F.length("text")))
    return corpus.table_aware_documents(_docs(spark, d).select(F.concat(F.lit("doc-"), "doc_id").alias("source"), text.alias("text"))).select("doc_id", "page_content", "metadata.type", "metadata.chunk_id", "metadata.source")


@query()
def html_to_markdown(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", to_markdown("html").alias("markdown"))


@query()
def process_uploads(spark, d):
    """Pages as uploaded files."""
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return corpus.process_uploads(pages.select(F.concat(F.when(F.col("page_id") % 10 == 0, "../").otherwise("up/"), "page_id", F.lit(".html")).alias("filename"), F.col("html").alias("text")))


@query(r"SELECT doc_id, len(t)::INTEGER AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS t FROM documents)")
def tokenize(spark, d):
    t = bm25.tokenize(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(t).alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


@query()
def segment_words(spark, d):
    """The words of every document, found again in its text without blanks by a dictionary of all documents' words."""
    docs = _docs(spark, d).select("doc_id", "text")
    # the words of bm25.tokenize: empty ones go after they are exploded
    words = docs.select(F.explode(F.split("text", r"(?U)\s+")).alias("word")).filter("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    cut = segment.Segmenter(segment.dictionary_of(words), runs=r"\S+")
    return docs.select("doc_id", bm25.tokenize_zh(F.regexp_replace("text", r"(?U)\s+", ""), segment=cut).alias("words"))


FINGERPRINT_SQL = """hashed AS (SELECT source, md5(text || ':' || lang) AS h FROM {docs}), leaves AS (SELECT source, h[1:4] AS p, md5(string_agg(h, '' ORDER BY h)) AS h, count(*) AS n FROM hashed GROUP BY 1, 2), parts AS (SELECT source, p[1:2] AS p, md5(string_agg(h, '' ORDER BY leaves.p)) AS h, sum(n) AS n FROM leaves GROUP BY source, leaves.p[1:2]),
{name} AS (SELECT source, md5(string_agg(h, '' ORDER BY p)) AS fingerprint, sum(n)::BIGINT AS chunks FROM parts GROUP BY 1)"""


@query(f"WITH {FINGERPRINT_SQL.format(docs='documents', name='f')} SELECT md5(string_agg(source || ':' || fingerprint, '' ORDER BY source || ':' || fingerprint)) AS fingerprint FROM f")
def corpus_fingerprint(spark, d):
    return corpus.corpus_fingerprint(_chunks(spark, d))


@query(f"WITH {FINGERPRINT_SQL.format(docs='documents', name='f')} SELECT source, fingerprint, chunks FROM f")
def source_fingerprints(spark, d):
    return corpus.source_fingerprints(_chunks(spark, d))


_MULTISET_SQL = " || '-' || ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT)::VARCHAR" for i in range(8))


@query(f"SELECT source, {_MULTISET_SQL} AS fingerprint, count(*) AS chunks FROM (SELECT source, sha256(coalesce(length(text), -1) || ':' || coalesce(text, '') || ':' || coalesce(length(lang), -1) || ':' || coalesce(lang, '')) AS h FROM documents) GROUP BY 1")
def updated_fingerprints(spark, d):
    """Fingerprints of an older state (a third of the chunks missing, a fifth in another wording) brought up to date from what came and went."""
    chunks = _chunks(spark, d)
    missing, other = F.col("doc_id") % 3 == 0, F.col("doc_id") % 5 == 0
    old = chunks.filter(~missing).withColumn("page_content", F.when(other, F.upper("page_content")).otherwise(F.col("page_content")))
    sums = corpus.updated_sums(corpus.multiset_sums(old), chunks.filter(missing | other), old.filter(other))
    return corpus.sums_fingerprint(sums)


@query(
    """WITH old AS (SELECT source, count(*) AS n, sum(doc_id) AS s FROM documents WHERE source <> 'src3' AND NOT (source = 'src5' AND doc_id % 2 = 0) GROUP BY 1), new AS (SELECT source, count(*) AS n, sum(doc_id) AS s FROM documents WHERE source <> 'src7' GROUP BY 1)
SELECT coalesce(o.source, n.source) AS source, CASE WHEN o.source IS NULL THEN 'added' WHEN n.source IS NULL THEN 'removed' WHEN o.n <> n.n OR o.s <> n.s THEN 'changed' ELSE 'same' END AS change FROM old o FULL JOIN new n ON o.source = n.source"""
)
def detect_changes(spark, d):
    """Two states of the corpus: one without a source and half of another, one without a third."""
    chunks = _chunks(spark, d)
    old = corpus.source_fingerprints(chunks.filter("source <> 'src3' AND NOT (source = 'src5' AND doc_id % 2 = 0)"))
    return corpus.detect_changes(old, corpus.source_fingerprints(chunks.filter("source <> 'src7'")))


@query("SELECT count(*) AS n_chunks, count(*) FILTER (text IS NULL) AS n_missing, count(*) >= 0.5 * 20 AS valid, NULL::VARCHAR AS reason FROM documents")
def validate_corpus(spark, d):
    return corpus.validate_corpus(_chunks(spark, d), directories=20)


@query("SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS missing, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS orphaned, false AS aligned")
def index_alignment(spark, d):
    """The labels as an index of the documents."""
    return corpus.index_alignment(_docs(spark, d), spark.read.parquet(f"{d}/labels.parquet"))


TOKENS_SQL = r"tokens AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS t FROM documents)"
INDEX_SQL = f"""{TOKENS_SQL}, postings AS MATERIALIZED (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tokens) GROUP BY ALL), sizes AS (SELECT doc_id, len(t) AS dl FROM tokens),
n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sizes), raws AS MATERIALIZED (SELECT term, count(*) AS df, ln((SELECT n FROM n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM postings GROUP BY term),
mean AS MATERIALIZED (SELECT avg(raw) AS mean_raw FROM raws), terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * mean_raw ELSE raw END AS idf FROM raws, mean)"""
SEARCH_SQL = f"""{INDEX_SQL}, asked AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT query_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM asked JOIN terms USING (term) JOIN postings USING (term) JOIN sizes USING (doc_id), n GROUP BY ALL),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)"""


def _index(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return bm25.build_index(_docs(spark, d).select("doc_id", bm25.tokenize(F.col("text")).alias("tokens")))


def _items(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _hits(spark: SparkSession, d: str, n: int = 20) -> DataFrame:
    return bm25.search(_items(spark, d).select("query_id", bm25.tokenize(F.col("query")).alias("tokens")), _index(spark, d), n)


@query(f"WITH {INDEX_SQL} SELECT term, df, round(idf, 6) AS idf FROM terms")
def bm25_index(spark, d):
    return _index(spark, d)["terms"].withColumn("idf", F.round("idf", 6))


@query(f"WITH {SEARCH_SQL} SELECT query_id, doc_id, round(score, 4) AS score, rank FROM hits WHERE rank <= 20")
def bm25_search(spark, d):
    return _hits(spark, d).withColumn("score", F.round("score", 4))


@query(f"WITH {SEARCH_SQL} SELECT query_id, doc_id, round(score, 4) AS score, rank FROM hits WHERE rank <= 20")
def bm25_search_blocks(spark, d):
    """The same over packed blocks, of which only those that may matter are read."""
    asked = _items(spark, d).select("query_id", bm25.tokenize(F.col("query")).alias("tokens"))
    return blockmax.search(asked, blockmax.pack(_index(spark, d), queries=asked), 20).withColumn("score", F.round("score", 4))


@query("SELECT d.doc_id AS hit_id, f.doc_id AS doc_id FROM documents d JOIN (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY 1) f ON d.text = f.text")
def resolve_passages(spark, d):
    """Every document as a hit: the first with its text."""
    chunks = _chunks(spark, d).select("doc_id", "page_content")
    return bm25.resolve_passages(chunks.withColumnRenamed("doc_id", "hit_id"), chunks).select("hit_id", "doc_id")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")


def _vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).filter("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


NORM_SQL = "sqrt(list_sum(list_transform({v}, lambda x: x::DOUBLE * x::DOUBLE)))"


def _shown(v) -> Column:
    """All components, as whole numbers of 1/100,000."""
    return F.array_join(F.transform(v, lambda x: F.round(x * 100_000).cast("long").cast("string")), ",")


SHOWN_SQL = "array_to_string(list_transform({v}, lambda x: round(x / n * 100000)::BIGINT), ',')"


@query(f"SELECT vec_id, {SHOWN_SQL.format(v='v')} AS components FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (vec_id + 1)) AS v, {NORM_SQL.format(v='list_transform(embedding, lambda x: x::DOUBLE * (vec_id + 1))')} AS n FROM embeddings)")
def l2_normalize(spark, d):
    """Vectors stretched by their number, and brought back."""
    v = vectors.l2_normalize(F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") + 1)))
    return _vectors(spark, d).select("vec_id", _shown(v).alias("components"))


@query(f"SELECT vec_id, 32 AS dims, {SHOWN_SQL.format(v='embedding[1:32]')} AS components FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS embedding, {NORM_SQL.format(v='embedding[1:32]')} AS n FROM embeddings)")
def truncate_dims(spark, d):
    v = vectors.truncate_dims(F.col("embedding"), 32)
    return _vectors(spark, d).select("vec_id", F.size(v).alias("dims"), _shown(v).alias("components"))


def _knn_sql(rows: str, k: int, pairs: str = "q JOIN v ON true") -> str:
    return f"SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank FROM (SELECT q.query_id, v.vec_id, round(list_distance(q.{rows}, v.{rows}), 5) AS distance FROM {pairs}) QUALIFY rank <= {k}"


def _cut_sql(d: int) -> str:
    return f"list_transform(embedding[1:{d}], lambda x: x::DOUBLE / {NORM_SQL.format(v=f'embedding[1:{d}]')})"


VECTORS_SQL = f"v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, {_cut_sql(16)} AS e16, {_cut_sql(32)} AS e32 FROM embeddings), q AS (SELECT vec_id AS query_id, * EXCLUDE (vec_id) FROM v WHERE vec_id % 25 = 0)"


@query(f"WITH {VECTORS_SQL} {_knn_sql('e', 20)}")
def knn_exact(spark, d):
    return vectors.knn_exact(_vector_queries(spark, d), _vectors(spark, d), 20, digits=5)


STAGED_SQL = f"WITH {VECTORS_SQL}, s1 AS ({_knn_sql('e16', 60)}), s2 AS ({_knn_sql('e32', 30, 's1 JOIN q USING (query_id) JOIN v USING (vec_id)')})\n{_knn_sql('e', 10, 's2 JOIN q USING (query_id) JOIN v USING (vec_id)')}"


@query(STAGED_SQL)
def knn_staged(spark, d):
    return vectors.knn_staged(_vector_queries(spark, d), _vectors(spark, d), [(16, 60), (32, 30), (64, 10)], digits=5)


@query()
def knn_ivf(spark, d):
    """11 of 16 cells: the fewest but one with a recall of 0.9 or more at every size measured (README)."""
    celled, centres = vectors.build_ivf(_vectors(spark, d), nlist=16)
    return vectors.knn_ivf(_vector_queries(spark, d), celled, centres, k=20, nprobe=11, digits=5)


@query()
def knn_index(spark, d):
    """Searches by codes in 25 of 32 cells, ranked exactly; recall by cells in README."""
    v = _vectors(spark, d)
    return vector_index.search_index(_vector_queries(spark, d), vector_index.build_index(v, nlist=32), v, k=20, nprobe=25, digits=5)


@query()
def whitening(spark, d):
    v = _vectors(spark, d)
    mean, matrix = vectors.fit_whitening(v, 16)
    return vectors.apply_whitening(v, mean, matrix)


@query("SELECT i::INTEGER AS i, j::INTEGER AS j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS covariance, (SELECT count(*) FROM embeddings) AS vectors FROM range(16) x(i), range(16) y(j)")
def whitening_covariance(spark, d):
    """The covariance of every two components of the whitened vectors, over all vectors."""
    y = F.col("embedding")
    x = whitening(spark, d).select(y, F.posexplode(y).alias("i", "a")).select("i", "a", F.posexplode(y).alias("j", "b"))
    return x.groupBy("i", "j").agg((F.round(F.covar_samp("a", "b"), 4) + 0.0).alias("covariance"), F.count(F.lit(1)).alias("vectors"))


@query()
def embed_texts(spark, d):
    return vectors.embed_texts(_docs(spark, d).select("doc_id", "text"))


@query()
def embed_queries(spark, d):
    return vectors.embed_queries(_items(spark, d))


def _two_methods(spark: SparkSession, d: str) -> DataFrame:
    """BM25 hits, and the same from the end as a second method."""
    hits = _hits(spark, d).join(_chunks(spark, d).select("doc_id", "page_content"), "doc_id")
    back = hits.select("doc_id", "query_id", "score", (21 - F.col("rank")).alias("rank"), "page_content", F.lit("emb").alias("method"))
    return hits.withColumn("method", F.lit("bm25")).unionByName(back)


MERGED_SQL = f"""{SEARCH_SQL}, pooled AS (SELECT query_id, doc_id, rank, 0 AS p FROM hits WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, 21 - rank, 1 FROM hits WHERE rank <= 20),
once AS (SELECT b.query_id, d.doc_id, p, rank FROM pooled b JOIN documents d USING (doc_id) QUALIFY row_number() OVER (PARTITION BY b.query_id, d.text ORDER BY p, rank) = 1),
merged AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY p, rank)::INTEGER AS rank FROM once)"""


@query(f"WITH {MERGED_SQL} SELECT * FROM merged")
def hybrid_merge(spark, d):
    return ranking.hybrid_merge(_two_methods(spark, d), ("bm25", "emb")).select("query_id", "doc_id", "rank")


@query(f"WITH {MERGED_SQL} SELECT query_id, string_agg(text, chr(10) ORDER BY rank) AS context, count(*) AS n_docs FROM merged JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY 1")
def build_contexts(spark, d):
    merged = ranking.hybrid_merge(_two_methods(spark, d), ("bm25", "emb")).filter("rank <= 5")
    return ranking.build_contexts(merged)


@query(f"WITH {MERGED_SQL} SELECT query_id, rank, CASE WHEN doc_id % 2 = 0 THEN source ELSE '文档片段 ' || rank END AS filename, text AS context FROM merged JOIN documents USING (doc_id) WHERE rank <= 5")
def reference_docs(spark, d):
    """Of the best five; every other document has lost its source."""
    merged = ranking.hybrid_merge(_two_methods(spark, d), ("bm25", "emb")).filter("rank <= 5")
    source = F.when(F.col("doc_id") % 2 == 0, F.col("source"))
    return ranking.reference_docs(merged.join(_docs(spark, d).select("doc_id", source.alias("source")), "doc_id"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d).join(_chunks(spark, d).select("doc_id", "page_content"), "doc_id")
    return hits.join(_items(spark, d), "query_id").select("query_id", "query", "doc_id", "rank", "page_content")


@query()
def score_pairs(spark, d):
    return ranking.score_pairs(_candidates(spark, d)).select("query_id", "doc_id", "rerank_score", "ok")


@query()
def rerank(spark, d):
    return ranking.rerank(_candidates(spark, d)).select("query_id", "doc_id", "rank", "rerank_score", "ok")


@query()
def answer_retrieval(spark, d):
    return answer(_items(spark, d), _chunks(spark, d), _index(spark, d))
