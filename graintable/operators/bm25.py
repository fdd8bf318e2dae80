"""Tokens, the BM25 index and search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..durable import durable
from ..functions.slices import sliced

K1, B, EPSILON = 1.5, 0.75, 0.25


def tokenize(text: Column) -> Column:
    """Words between blanks, with their case."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda x: x != "")


def cjk_bigrams(text: str | None) -> list[str]:
    """Pairs of neighbouring CJK characters; other words as they are. Stands in for a word segmenter."""
    out: list[str] = []
    word = ""
    for c in (text or "") + " ":
        wide = "㐀" <= c <= "鿿"
        if word and (c.isspace() or wide != ("㐀" <= word[-1] <= "鿿")):
            out += [word[i : i + 2] for i in range(max(1, len(word) - 1))] if "㐀" <= word[-1] <= "鿿" else [word]
            word = ""
        word += "" if c.isspace() else c
    return out


def tokenize_zh(text: Column, stopwords: frozenset[str] = frozenset(), segment: Callable[[str | None], list[str]] = cjk_bigrams) -> Column:
    """Words of a pluggable segmenter, without stopwords and blanks. Queries take no stopwords. A segmenter with ``many`` gets several texts at once."""
    many = getattr(segment, "many", None) or (lambda texts: map(segment, texts))

    return sliced(lambda texts: [[w for w in words if w.strip() and w not in stopwords] for words in many(texts)], "array<string>", together=True)(text)


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("word")).filter("word <> ''").distinct()


def singled(tokens: DataFrame, merge: Callable[[Column], Column]) -> DataFrame:
    """tokens: doc_id, tokens. One row for each doc_id: doc_id, tokens, dl and lengths. Rows of a repeated doc_id become one by ``merge`` (an aggregate of tokens), and lengths
    holds the length of each; else it is null. Only the ids and the rows of repeated ids are shuffled."""
    size = F.size("tokens").cast("long")
    repeated = durable(tokens.groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_id"), "repeated-ids")
    same = F.col("doc_id").eqNullSafe(F.col("_id"))
    once = tokens.join(repeated, same, "left_anti").select("doc_id", "tokens", size.alias("dl"), F.lit(None).cast("array<long>").alias("lengths"))
    merged = tokens.join(repeated, same, "left_semi").groupBy("doc_id").agg(merge(F.col("tokens")).alias("tokens"), F.collect_list(size).alias("lengths"))
    return once.unionByName(merged.select("doc_id", "tokens", size.alias("dl"), "lengths"))


def counted(documents: DataFrame) -> DataFrame:
    """documents: of ``singled``. term, doc_id, tf, dl, lengths: a row for each word of each. Words are counted within their row, so no posting is shuffled."""
    words, n = F.col("_words"), F.size("_words")
    held = documents.select("doc_id", "dl", "lengths", F.sort_array("tokens").alias("_words")).filter(n > 0)
    first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | ~F.get(words, i).eqNullSafe(F.get(words, i - 1)))
    held = held.withColumn("_first", first)
    runs = F.transform("_first", lambda i, k: F.struct(F.get(words, i).alias("term"), (F.coalesce(F.get(F.col("_first"), k + 1), n) - i).cast("long").alias("tf")))
    return held.select("doc_id", "dl", "lengths", F.explode(runs).alias("_p")).select("_p.term", "doc_id", "_p.tf", "dl", "lengths")


def impact(avgdl: Column) -> Column:
    """What a posting (tf, dl, lengths) adds to a score for each unit of its term's weight; of a repeated document, all rows add up."""
    tf = F.col("tf")
    of = lambda dl: tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
    return F.when(F.col("lengths").isNull(), of(F.col("dl"))).otherwise(F.aggregate("lengths", F.lit(0.0), lambda s, x: s + of(x)))


def build_index(tokens: DataFrame) -> dict[str, DataFrame]:
    """tokens: doc_id, tokens. Tables postings (term, doc_id, tf, dl, lengths), documents (doc_id, dl), terms (term, df, idf) and totals (n, avgdl, avg_idf).

    idf is ln(N - df + 0.5) - ln(df + 0.5), and a quarter of the mean over the vocabulary where that is negative. The three tables that grow
    with the corpus are written once, so that searches don't make them again. Postings keep their document's length (lengths: of a repeated doc_id, those of all
    its rows), so that searches don't join them with documents.
    """
    postings = durable(counted(singled(tokens, lambda t: F.flatten(F.collect_list(t)))), "postings")
    documents = durable(tokens.select("doc_id", F.size("tokens").cast("long").alias("dl")), "lengths")
    counts = documents.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    # a document's term is one posting, so the partial counts are all that is shuffled here
    raw = durable(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequencies").crossJoin(F.broadcast(counts)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    totals = raw.agg(F.avg("raw").alias("avg_idf")).crossJoin(F.broadcast(counts)).select("n", "avgdl", "avg_idf")
    terms = durable(raw.drop("n", "avgdl").crossJoin(F.broadcast(totals.select("avg_idf"))).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("avg_idf")).otherwise(F.col("raw")).alias("idf")), "terms")
    return {"postings": postings, "documents": documents, "terms": terms, "totals": totals}


def search(queries: DataFrame, index: dict[str, DataFrame], n: int = 20, pad: bool = False, digits: int = 6) -> DataFrame:
    """queries: query_id, tokens. The n best documents of each: query_id, doc_id, score, rank; ties by doc_id. A repeated query word counts each time.

    Postings are cut to the queries' terms before anything else. With ``pad``, documents that share no word fill up short answers with
    score 0, by doc_id.
    """
    asked = queries.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    # a stored index is cut into parts by a hash of the term: only the parts of the queries' terms are read
    on = [c for c in ("part", "term") if c in index["terms"].columns and c in index["postings"].columns]
    # written, so that its size is known: the postings stay where they are if it is small
    weighted = durable(asked.join(index["terms"].select(*on, "idf"), "term").select("query_id", *on, (F.col("times") * F.col("idf")).alias("_w")), "weights")
    hits = index["postings"].filter("doc_id is not null").crossJoin(F.broadcast(index["totals"].select("avgdl"))).withColumn("_impact", impact(F.col("avgdl"))).join(weighted, on)
    # a document's postings lie together, so most of a sum is made before the shuffle
    scored = hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("_w") * F.col("_impact")), digits).alias("score"))
    if pad:
        first = index["documents"].select("doc_id").orderBy("doc_id").limit(n)
        zero = queries.select("query_id").crossJoin(F.broadcast(first)).join(scored, ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
        scored = scored.unionByName(zero)
    else:
        scored = scored.filter("score > 0")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= n)


def resolve_passages(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """hits: with page_content. Each with doc_id: the first document of that very text. Joined on a hash of the text, then on the text."""
    first = corpus.select(F.xxhash64("page_content").alias("_h"), F.col("page_content").alias("_text"), "doc_id").join(hits.select(F.xxhash64("page_content").alias("_h")).distinct(), "_h", "left_semi")
    first = first.groupBy("_h", "_text").agg(F.min("doc_id").alias("doc_id"))
    joined = hits.withColumn("_h", F.xxhash64("page_content")).join(first, "_h", "left").filter(F.col("_text").isNull() | (F.col("_text") == F.col("page_content")))
    return joined.drop("_h", "_text")
