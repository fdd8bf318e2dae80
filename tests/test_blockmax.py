"""BM25 by blocks against the plain search: equal hits, fewer postings."""

import random

import pytest
from pyspark.sql import functions as F

from graintable.operators import blockmax, bm25
from graintable.sources import stores

TOKENS = "long, tokens array<string>"


def hits(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 5)) for r in df.collect())


@pytest.mark.parametrize(("letters", "size", "n"), [("abcdefgh", 4, 10), ("ab", 2, 3), ("abcdefghijklmnopqrstuvwxyz", 8, 5), ("abc", 128, 200)])
def test_equal_to_the_plain_search(spark, letters, size, n):
    """Frequent words, whose weight may be negative, repeated query words, words that no document has, empty documents and queries."""
    draw = random.Random(len(letters) + n)
    docs = [(i, [draw.choice(letters[: draw.randint(1, len(letters))]) for _ in range(draw.randint(0, 15))]) for i in range(300)]
    asked = [(i, [draw.choice(letters + "?") for _ in range(draw.randint(0, 6))]) for i in range(25)]
    index = blockmax.pack(bm25.build_index(spark.createDataFrame(docs, f"doc_id {TOKENS}")), size)
    queries = spark.createDataFrame(asked, f"query_id {TOKENS}")
    assert hits(blockmax.search(queries, index, n)) == hits(bm25.search(queries, index, n))


def test_blocks_hold_all_postings(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.array(F.lit("all"), F.concat(F.lit("r"), F.col("id") % 700)).alias("tokens"))
    index = blockmax.pack(bm25.build_index(docs), 32)
    flat = index["blocks"].select("term", F.explode("postings").alias("p")).select("term", "p.doc_id")
    assert sorted(map(tuple, flat.collect())) == sorted((r["term"], r["doc_id"]) for r in index["postings"].collect())
    assert index["blocks"].agg(F.max("n")).first()[0] < 100 and index["blocks"].filter("term = 'all'").count() == 128


def test_a_frequent_term_is_passed_over(spark):
    """A third of 20,000 documents have the word; fewer than half of its postings are in blocks that are read. (Blocks are small, as the table
    is: a block is looked up for each document that may be among the best, and these don't grow with a frequent word.)"""
    draw = random.Random(5)
    docs = [(i, ["hot"] * (i % 3 == 0) * draw.randint(1, 3) + [f"w{int(draw.paretovariate(0.6))}" for _ in range(draw.randint(5, 30))]) for i in range(20_000)]
    index = blockmax.pack(bm25.build_index(spark.createDataFrame(docs, f"doc_id {TOKENS}")), 16)
    queries = spark.createDataFrame([(1, ["hot", "w150", "w900"]), (2, ["w40", "hot"]), (3, ["hot", "w20", "w35", "w77"])], f"query_id {TOKENS}")
    want = hits(bm25.search(queries, index, 10))
    tables = blockmax.passes(queries, index, 10)
    assert hits(tables["hits"]) == want
    read = tables["first"].unionByName(tables["second"]).distinct().filter("term = 'hot'").groupBy("query_id").agg(F.sum("n").alias("n")).collect()
    read = {r["query_id"]: r["n"] for r in read}
    # the third query's words are nearly alike in weight, so many documents stay in question
    assert read[1] < 0.25 * 6667 and read[2] < 0.25 * 6667 and sum(read.values()) < 0.5 * 3 * 6667


def test_a_stored_index_is_searched_alike(spark, tmp_path):
    draw = random.Random(6)
    docs = [(i, [f"w{int(draw.paretovariate(0.7))}" for _ in range(20)]) for i in range(500)]
    index = blockmax.pack(bm25.build_index(spark.createDataFrame(docs, f"doc_id {TOKENS}")), 16)
    stores.write_bm25_index(index, f"{tmp_path}/i", 8)
    stored = stores.read_bm25_index(spark, f"{tmp_path}/i", blocks=True)
    queries = spark.createDataFrame([(i, [f"w{draw.randint(1, 60)}" for _ in range(4)]) for i in range(12)], f"query_id {TOKENS}")
    want = hits(bm25.search(queries, index, 7))
    assert hits(blockmax.search(queries, stored, 7)) == want == hits(bm25.search(queries, stored, 7))


def test_packed_for_some_queries(spark):
    """Only postings that are asked for are packed; weights and hits are those of the whole index."""
    draw = random.Random(8)
    docs = [(i, [f"w{int(draw.paretovariate(0.7))}" for _ in range(20)]) for i in range(400)]
    index = bm25.build_index(spark.createDataFrame(docs, f"doc_id {TOKENS}"))
    queries = spark.createDataFrame([(1, ["w1", "w3", "w3"]), (2, ["w2", "none"]), (3, [])], f"query_id {TOKENS}")
    packed = blockmax.pack(index, 16, queries)
    assert {r["term"] for r in packed["blocks"].select("term").collect()} == {"w1", "w2", "w3"}
    assert packed["postings"].count() == index["postings"].count()
    want = hits(bm25.search(queries, index, 7))
    assert hits(blockmax.search(queries, packed, 7)) == want and len(want) == 14
