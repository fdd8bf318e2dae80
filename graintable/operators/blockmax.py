"""BM25 search that passes over postings that can't matter.

The postings of a term are packed into blocks of about BLOCK by a hash of the document; a block keeps the largest impact in it (what a posting
adds to a score is its term's weight times its impact), a term its largest impact and its TOPS best ones. These give every query a score that its n best documents
reach at least. That score is dealt to the query's terms, the most frequent first, as budgets: a document of which every posting stays
within its term's budget can't be among the n best. So a first pass reads only blocks with a larger impact than the budget, mostly of rare
terms. For the n documents that are best by then the remaining terms are looked up, each in the one block that may hold the document: their whole scores
raise the threshold, and only documents that may still reach it are looked up, too. Blocks that nothing asks for are neither
unpacked nor shuffled. A query that leaves more than MANY documents to look up reads the rest of its terms' blocks instead, so no search does more than a
plain one by orders of magnitude. Results are those of ``bm25.search``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable
from .bm25 import impact as of_posting

BLOCK, TOPS, MANY = 128, 64, 1024
#: scores are rounded to six digits; thresholds stay below by more
MARGIN = 1e-5


def _block(doc: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(doc), blocks).cast("int")


def pack(index: dict[str, DataFrame], size: int = BLOCK, queries: DataFrame | None = None) -> dict[str, DataFrame]:
    """An index (``bm25.build_index``) with blocks (term, block, n, most, postings of doc_id and impact) and, in terms, blocks (their number), most and tops.

    queries: as for ``search``, of an index that is packed for them alone: postings and terms that none of them asks for stay as they are, unpacked. Weights are those of the whole index.
    """
    if queries is not None:
        asked = durable(queries.select(F.explode("tokens").alias("term")).distinct(), "asked-terms")
        packed = pack({**index, **{name: index[name].join(asked, "term", "left_semi") for name in ("postings", "terms")}}, size)
        return {**packed, "postings": index["postings"]}
    frequency = F.col("df")
    number = F.when(frequency <= size, 1).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(frequency / F.lit(float(size)))))).cast("int")
    terms = index["terms"].withColumn("blocks", number)
    # only frequent terms have several blocks; written, so that their number is known and the postings aren't shuffled for it
    several = durable(terms.filter("blocks > 1").select("term", "blocks"), "several-blocks")
    dealt = index["postings"].filter("doc_id is not null").join(several, "term", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).crossJoin(F.broadcast(index["totals"].select("avgdl")))
    impact = of_posting(F.col("avgdl"))
    posting = F.struct("doc_id", impact.alias("impact"))
    # blocks are of even size, whatever the term: no group grows with a term's frequency
    packed = dealt.withColumn("block", _block(F.col("doc_id"), F.col("blocks"))).groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), F.max(impact).alias("most"), F.first("blocks").alias("blocks"), F.collect_list(posting).alias("postings"))
    packed = durable(packed, "blocks")
    # the best few of each block: as many documents have such an impact or a larger one
    own = F.slice(F.sort_array(F.transform("postings", lambda p: p["impact"]), asc=False), F.lit(1), F.greatest(F.expr(f"{TOPS} div blocks"), F.lit(1)).cast("int"))
    tops = packed.filter(F.col("blocks") <= MANY).select("term", own.alias("own")).groupBy("term").agg(F.slice(F.sort_array(F.flatten(F.collect_list("own")), asc=False), 1, TOPS).alias("tops"))
    most = packed.groupBy("term").agg(F.max("most").alias("most"))
    whole = terms.join(most, "term").join(tops, "term", "left")
    return {**index, "terms": durable(whole, "block-terms"), "blocks": packed.drop("blocks")}


def passes(queries: DataFrame, index: dict[str, DataFrame], n: int = 20, digits: int = 6) -> dict[str, DataFrame]:
    """queries: query_id, tokens. The tables of a search: plan (a row for each query and term), first and second (the blocks that each pass reads, with n) and hits (as ``bm25.search``)."""
    blocks = index["blocks"]
    # a stored index is cut into parts by a hash of the term: only the parts of the queries' terms are read
    on = [c for c in ("part", "term") if c in blocks.columns and c in index["terms"].columns]
    asked = queries.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    weight = F.col("times") * F.col("idf")
    weighed = asked.join(index["terms"], "term").select("query_id", *on, "df", F.col("blocks"), weight.alias("w"), (weight * F.col("most")).alias("most"), F.when(F.size("tops") >= n, weight * F.get("tops", F.lit(n - 1))).alias("reached"))
    query = Window.partitionBy("query_id")
    # what terms of negative weight may take away
    loss = F.sum(F.least("most", F.lit(0.0))).over(query)
    sure = F.greatest(F.coalesce(F.max("reached").over(query) + loss, F.lit(0.0)) - MARGIN, F.lit(0.0))
    gain = F.greatest("most", F.lit(0.0))
    hotter = query.orderBy(F.col("df").desc(), "term").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_sure") - F.coalesce(F.sum(gain).over(hotter), F.lit(0.0))
    plan = weighed.withColumn("_sure", sure).withColumn("_loss", loss).withColumn("budget", F.greatest(F.least(gain, left), F.lit(0.0)))
    plan = durable(plan.withColumn("_budgets", F.sum("budget").over(query)).select("query_id", *on, "blocks", "w", "budget", "_loss", "_budgets"), "search-plan")

    over = F.col("w") * F.col("most") > F.col("budget")
    first = blocks.join(plan, on).filter(over)
    found = first.select("query_id", "w", "budget", "_loss", "_budgets", F.explode("postings").alias("p"))
    partial = found.groupBy("query_id", F.col("p.doc_id").alias("doc_id")).agg(F.sum(F.col("w") * F.col("p.impact")).alias("part"), F.sum("budget").alias("_found"), F.first("_loss").alias("_loss"), F.first("_budgets").alias("_budgets"))
    partial = durable(partial, "search-partial")
    rest = plan.filter((F.col("budget") > 0) | (F.col("w") < 0))

    def lookups(documents: DataFrame) -> DataFrame:
        """The blocks that may hold what the first pass left out of some documents, with these."""
        wanted = documents.select("query_id", "doc_id").join(rest, "query_id").withColumn("block", _block(F.col("doc_id"), F.col("blocks")))
        return blocks.join(wanted.select("query_id", "doc_id", *on, "block", "w", "budget"), [*on, "block"]).filter(~over)

    def completed(documents: DataFrame) -> DataFrame:
        doc = F.col("doc_id")
        posting = F.get(F.filter("postings", lambda p: p["doc_id"] == doc), F.lit(0))
        more = lookups(documents).select("query_id", "doc_id", (F.col("w") * posting["impact"]).alias("part")).filter("part is not null")
        return documents.select("query_id", "doc_id", "part").unionByName(more).groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))

    best = partial.withColumn("_i", F.row_number().over(query.orderBy(F.col("part").desc(), "doc_id"))).filter(F.col("_i") <= n)
    best = durable(best, "search-best")
    reached = completed(best).groupBy("query_id").agg(F.count(F.lit(1)).alias("_k"), F.min("score").alias("_least"))
    may = F.col("part") + F.col("_budgets") - F.col("_found") >= F.when(F.col("_k") >= n, F.col("_least") - MARGIN).otherwise(float("-inf"))
    candidates = partial.join(reached, "query_id").filter(may).select("query_id", "doc_id", "part")
    # looking up very many documents costs more than reading all blocks that are left: such queries are scored by these
    many = durable(candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > MANY).select("query_id"), "search-many")
    left_over = durable(candidates.join(many, "query_id", "left_anti"), "search-candidates")
    whole = blocks.join(durable(rest.join(many, "query_id", "left_semi"), "search-rest"), on).filter(~over)
    parts = whole.select("query_id", "w", F.explode("postings").alias("p")).select("query_id", "p.doc_id", (F.col("w") * F.col("p.impact")).alias("part"))
    read_whole = parts.unionByName(partial.join(many, "query_id", "left_semi").select("query_id", "doc_id", "part")).groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))
    second = lookups(best).unionByName(lookups(left_over)).select("query_id", *on, "block", "n").unionByName(whole.select("query_id", *on, "block", "n"))
    scored = completed(left_over).unionByName(read_whole).withColumn("score", F.round("score", digits)).filter("score > 0")
    rank = F.row_number().over(query.orderBy(F.col("score").desc(), "doc_id"))
    hits = scored.withColumn("rank", rank).filter(F.col("rank") <= n)
    read = lambda df: df.select("query_id", "term", "block", "n").distinct()
    return {"plan": plan, "first": read(first), "second": read(second), "hits": hits}


def search(queries: DataFrame, index: dict[str, DataFrame], n: int = 20, digits: int = 6) -> DataFrame:
    """The n best documents of each query: query_id, doc_id, score, rank; ties by doc_id. ``index``: of ``pack``."""
    return passes(queries, index, n, digits)["hits"]
