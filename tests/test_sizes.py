"""What goes wrong only with larger tables, shown on small ones."""

import duckdb
from pyspark.sql import functions as F

from graintable import registry

SF = "/root/testdata/sf0.001"


def write(df, path):
    df.coalesce(1).write.parquet(str(path))


def both(spark, name, folder):
    """Rows of a query and of its SQL over a folder of tables, sorted."""
    con = duckdb.connect()
    for p in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}/*.parquet')")
    got = con.execute(registry.ORACLES[name])
    names = [c[0] for c in got.description]
    return sorted(map(repr, map(tuple, registry.QUERIES[name](spark, str(folder)).select(names).collect()))), sorted(map(repr, got.fetchall()))


def test_direct_queries_with_part_keys_beyond_a_million(spark, tmp_path):
    """The SQL's key adds part keys to lines times a million: a later line may come first. An order whose first part is missing has no row."""
    for t in ("customer", "nation", "region", "orders"):
        write(spark.read.parquet(f"{SF}/{t}.parquet"), tmp_path / f"{t}.parquet")
    far = lambda c: F.when(F.col(c) % 3 == 0, F.col(c) + 1_500_000).otherwise(F.col(c))
    write(spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("l_partkey", far("l_partkey")), tmp_path / "lineitem.parquet")
    write(spark.read.parquet(f"{SF}/part.parquet").withColumn("p_partkey", far("p_partkey")).filter("p_partkey % 7 <> 0"), tmp_path / "part.parquet")
    got, want = both(spark, "direct_queries", tmp_path)
    assert got == want and len(want) > 100


DOCS = [(1, ["a", "b", "a"]), (2, ["b"]), (2, ["b", "c", "c"]), (3, []), (4, ["d", "a"]), (None, ["a", "e"]), (None, ["a"])] + [(i, ["f", "g"]) for i in range(5, 12)]
TOKENS = "long, tokens array<string>"


def test_bm25_search_without_a_join_with_documents(spark):
    """Postings carry lengths. Rows of a repeated doc_id are one document, of which each length counts; a null doc_id has postings and no hits."""
    from graintable.operators import bm25

    index = bm25.build_index(spark.createDataFrame(DOCS, f"doc_id {TOKENS}"))
    asked = spark.createDataFrame([(1, ["a", "b", "b"]), (2, ["c"]), (3, ["e", "z"])], f"query_id {TOKENS}")
    del index["documents"]
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in bm25.search(asked, index).collect()}
    idf = {r["term"]: r["idf"] for r in index["terms"].collect()}
    avgdl = sum(len(t) for _, t in DOCS) / len(DOCS)
    part = lambda w, tf, *dls: sum(idf[w] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) for dl in dls)
    want = {(1, 1): part("a", 2, 3) + 2 * part("b", 1, 3), (1, 2): 2 * part("b", 2, 1, 3), (1, 4): part("a", 1, 2), (2, 2): part("c", 2, 1, 3)}
    assert got == {k: round(v, 6) for k, v in want.items()}
    assert {r["term"]: r["df"] for r in index["terms"].collect()}["a"] == 3


def test_block_search_reads_all_blocks_for_many_candidates(spark, monkeypatch):
    """As plain search, also where every document left is one too many to look up; packing needs no table of documents."""
    from graintable.operators import blockmax, bm25

    docs = [(i, [w for k, w in enumerate("abcdef") if i % (k + 2) == 0] * (1 + i % 3)) for i in range(300)]
    index = bm25.build_index(spark.createDataFrame(docs, f"doc_id {TOKENS}"))
    asked = spark.createDataFrame([(1, ["a", "b"]), (2, ["c", "d", "e"]), (3, ["f"])], f"query_id {TOKENS}")
    want = sorted(map(tuple, bm25.search(asked, index, 5).collect()))
    packed = blockmax.pack({k: v for k, v in index.items() if k != "documents"}, 8)
    monkeypatch.setattr(blockmax, "MANY", 0)
    assert sorted(map(tuple, blockmax.search(asked, packed, 5).collect())) == want and len(want) == 15


def test_an_index_with_dead_documents_is_read_without_a_shuffle(spark, tmp_path):
    from graintable.sources import segments

    path = f"{tmp_path}/index"
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.array(F.lit("all"), F.concat(F.lit("w"), F.col("id"))).alias("tokens"))
    segments.update_index(docs, path)
    segments.update_index(docs.limit(0), path, docs.filter("doc_id < 9").select("doc_id"), 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        postings = segments.open_index(spark, path, 2)["postings"]
        assert postings.count() == 82
        assert "SortMergeJoin" not in postings._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_index_search_meets_by_blocks(spark):
    """Cells are searched block by block: no row for each query and vector; results are those of a plain scan of the probed cells."""
    import numpy as np

    from graintable.operators import vectors

    x = np.random.default_rng(3).normal(size=(400, 4)).astype("float32").round(1)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    celled, centres = vectors.build_ivf(rows, nlist=5)
    asked = rows.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    found = vectors.knn_ivf(asked, celled, centres, k=7, nprobe=2, digits=4)
    cell = {r["vec_id"]: r["cell"] for r in celled.collect()}
    want = []
    for q in range(0, 400, 20):
        probed = ((centres**2).sum(1) - 2 * x[q].astype(float) @ centres.T).argsort()[:2]
        near = sorted((round(float(np.sqrt(((x[q].astype(float) - x[v]) ** 2).sum())), 4), v) for v in range(400) if cell[v] in probed)[:7]
        want += [(q, v, d, i + 1) for i, (d, v) in enumerate(near)]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "v_vectors" in found._jdf.queryExecution().optimizedPlan().toString()


def test_few_python_objects_at_once():
    """Of a batch of 5,000 texts no more than a slice's results are Python objects at a time; nulls, an empty batch and a part of a batch are as they should be."""
    import weakref

    import pyarrow as pa

    from graintable.functions.slices import SLICE, sliced

    class Words(list):
        pass

    most = [0]

    def words(text):
        out = Words((text or "none").split())
        held.append(weakref.ref(out))
        most[0] = max(most[0], sum(r() is not None for r in held[-2 * SLICE :]))
        return out

    held: list = []
    run = sliced(words, "array<string>").func
    texts = pa.array([None if i % 7 == 0 else f"a {i}" for i in range(5000)])
    assert run(texts).to_pylist() == [["none"] if i % 7 == 0 else ["a", str(i)] for i in range(5000)]
    assert most[0] <= SLICE + 1
    assert run(texts.slice(1, 2)).to_pylist() == [["a", "1"], ["a", "2"]] and run(texts.slice(0, 0)).to_pylist() == []


def test_a_dictionary_in_little_memory():
    """A worker holds the dictionary of up to 500,000 words in a few hundred bytes a word."""
    import random
    import tracemalloc

    from graintable.functions.segment import Segmenter

    draw = random.Random(1)
    counts = {"".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(3, 14))): 1 for _ in range(50_000)}
    tracemalloc.start()
    try:
        cut = Segmenter(counts, runs=r"\S+")
        assert tracemalloc.get_traced_memory()[0] < 450 * len(counts)
    finally:
        tracemalloc.stop()
    assert "".join(cut("abcdefgh")) == "abcdefgh"


def test_names_are_paired_before_parts(spark, tmp_path):
    """Pairs grow with the names, not with the parts that bear them."""
    from graintable.plans import price_queries

    names = F.element_at(F.array(*map(F.lit, ["steel pipe", "steel bar", "copper pipe", "glass"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    part = spark.range(1000).select((F.col("id") % 900).alias("p_partkey")).withColumn("p_name", names)
    write(part, tmp_path / "part.parquet")
    assert price_queries._name_pairs(spark, str(tmp_path))[1].count() == 8
    assert registry.QUERIES["char_tfidf_cosine"](spark, str(tmp_path)).count() == 8


def test_queries_and_records_of_one_name_meet_by_their_other_fields(spark):
    """Many queries and many records of one name: pairs that meet before the last test are few, and what meets is right."""
    from graintable.operators import prices
    from graintable.schemas import PRICE_QUERY

    n = 400
    records = spark.createDataFrame([(f"r{i}", "zc_price", "steel", f"s{i % 200}", ["b", None, ""][i % 3], "2024-01-01", float(i)) for i in range(n)], "record_id string, channel string, materialName string, materialModelSpec string, brand string, releaseDate string, price double")
    asked = lambda i: {"materialModelSpec": f"s{i}" if i % 5 else "", "brand": "b" if i % 4 == 0 else None, "minPrice": 100.0 if i % 2 else None}
    queries = spark.createDataFrame([tuple({"query_id": i, "channel": "zc_price", "materialName": "steel" if i % 7 else None, **asked(i)}.get(f.name) for f in PRICE_QUERY) for i in range(1, n)], PRICE_QUERY)
    rows, want = [r.asDict() for r in records.collect()], set()
    for i in range(1, n):
        q = asked(i)
        want |= {(i, r["record_id"]) for r in rows if (not q["materialModelSpec"] or r["materialModelSpec"] == q["materialModelSpec"]) and (not q["brand"] or r["brand"] == "b") and r["price"] >= (q["minPrice"] or 0)}
    got = [(r["query_id"], r["record_id"]) for r in prices.filter_prices(records, queries).select("query_id", "record_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert prices.candidates(records, prices.names_asked(records, queries)).count() < len(want) * 1.5 < n * n / 4
