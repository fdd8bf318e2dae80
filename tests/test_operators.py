"""Operators on small hand-made frames."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from graintable.functions import html, routing, splitting
from graintable.operators import analysis, bm25, corpus, fuzzy, prices, ranking, vectors
from graintable.plans.recommend import recommend_prices
from graintable.schemas import PRICE_QUERY, PRICE_RESPONSE
from graintable.sources import files, stores
from graintable.sources.prices import response_errors, response_records
from graintable.streaming import dialogue


def one(spark, **columns):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])


# --- sources --------------------------------------------------------------------------------------------------------------------


def test_folder_and_catalogue(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# A\n\ntext")
    (tmp_path / "sub" / "b.TXT").write_text("skipped by case")
    (tmp_path / "sub" / "c.txt").write_text("c\r\nd")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    got = {r["source"]: (r["suffix"], r["text"]) for r in files.read_corpus_folder(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("md", "# A\n\ntext"), "c.txt": ("txt", "c\r\nd")}
    table = files.file_table(spark, str(tmp_path))
    assert files.list_files(table).count() == 4 and files.catalogue_totals(table).first()["total_count"] == 4
    before = files.folder_fingerprint(table).first()[0]
    (tmp_path / "e.md").write_text("new")
    assert files.folder_fingerprint(files.file_table(spark, str(tmp_path))).first()[0] != before
    asked = spark.createDataFrame([("a.md",), ("a.md",), ("gone.md",), ("../x",), ("",), (None,)], "filename string")
    status = {r["filename"]: (r["status"], r["reason"]) for r in files.delete_status(table, asked).collect()}
    assert status == {"a.md": ("deleted", None), "gone.md": ("failed", "文件不存在"), "../x": ("failed", "not allowed"), "": ("failed", "not allowed"), None: ("failed", "not allowed")}
    assert files.survivors(table, asked).count() == 3


def test_passages(spark, tmp_path):
    (tmp_path / "p.tsv").write_text('1\tone "two\n2\tthree\n')
    (tmp_path / "l.txt").write_text("  one \n\n\t\ntwo\n")
    assert [tuple(r) for r in files.read_passages_tsv(spark, f"{tmp_path}/p.tsv").collect()] == [("1", 'one "two'), ("2", "three")]
    assert [r[0] for r in files.read_passage_lines(spark, f"{tmp_path}/l.txt").collect()] == ["one", "two"]


def test_responses(spark, tmp_path):
    lines = ['{"code":200,"message":"ok","data":{"totalCount":1,"list":[{"record_id":"r","price":1.5}]}}', '{"code":500,"message":"down"}', '{"code":200,"data":{"totalCount":0}}', '{"code":200,"data":{"totalCount":0,"list":[]}}']
    (tmp_path / "r.json").write_text("\n".join(lines))
    got = spark.read.schema(PRICE_RESPONSE).json(f"{tmp_path}/r.json")
    assert [(r["record_id"], r["price"]) for r in response_records(got).collect()] == [("r", 1.5)]
    assert [tuple(r) for r in response_errors(got).collect()] == [(500, "down")]


def test_stores(spark, tmp_path):
    chunks = corpus.table_aware_documents(spark.createDataFrame([("s.md", "one\n| a |\n| b |\ntwo")], "source string, text string"))
    assert stores.write_corpus(chunks, f"{tmp_path}/c") and not stores.write_corpus(chunks, f"{tmp_path}/c", "x", "x")
    assert stores.read_corpus(spark, f"{tmp_path}/c").count() == chunks.count() == 3
    index = bm25.build_index(spark.createDataFrame([(1, ["a", "b"]), (2, ["a"])], "doc_id long, tokens array<string>"))
    stores.write_bm25_index(index, f"{tmp_path}/i", 4)
    stored = stores.read_bm25_index(spark, f"{tmp_path}/i")
    assert stored["postings"].count() == 3
    asked = spark.createDataFrame([(7, ["b", "a"])], "query_id long, tokens array<string>")
    assert bm25.search(asked, stored, pad=True).collect() == bm25.search(asked, index, pad=True).collect()
    v = spark.createDataFrame([(1, [1.0], 0), (2, [2.0], 1)], "vec_id long, embedding array<float>, cell int")
    stores.write_vectors(v, f"{tmp_path}/v")
    stores.write_vectors(v.limit(1), f"{tmp_path}/v", drop_old=False)
    assert spark.read.parquet(f"{tmp_path}/v").count() == 3


# --- corpus ---------------------------------------------------------------------------------------------------------------------


def test_page_text(spark):
    pages = [("s", 2, " second page here \n12 and more"), ("s", 1, "first page text"), ("s", 3, "short"), ("s", 4, "contents .............. 7 and more"), ("t", 1, None)]
    assert [tuple(r) for r in corpus.clean_page_text(spark.createDataFrame(pages, "source string, page_no int, text string")).collect()] == [("s", "first page textsecond page hereand more")]


def test_windows(spark):
    rows = [(n, "x" * n) for n in (0, 10, 11, 156, 166, 167, 256, 257, 600)]
    got = corpus.sliding_window_chunks(spark.createDataFrame(rows, "k int, text string"), "k").collect()
    for n, text in rows:
        want = [(s, text[s : s + 256]) for s in range(0, n, 156) if len(text[s : s + 256]) > 10]
        assert sorted((r["start"], r["chunk"]) for r in got if r["k"] == n) == want


def test_recursive_split():
    text = "\n\n".join(" ".join(f"w{i}" for i in range(j * 40, j * 40 + 40)) for j in range(6))
    chunks = splitting.recursive_split(text, 100, 20)
    assert all(len(c) <= 100 for c in chunks) and set(text.split()) <= {w for c in chunks for w in c.split()}
    assert splitting.recursive_split("", 10, 2) == splitting.recursive_split(None, 10, 2) == []
    assert splitting.recursive_split("x" * 30, 10, 0, ("\n", ",")) == ["x" * 30]  # no separator cuts it
    assert splitting.recursive_split("ab,cd,ef", 5, 0, (",",)) == ["ab,cd", ",ef"]  # a separator heads the piece behind it
    assert splitting.recursive_split("x" * 30, 10, 0) == ["x" * 10] * 3


@pytest.mark.parametrize("end", ["\n", "\r\n", "\x0c"])
def test_tables_keep_their_context(spark, end):
    text = end.join(["intro", "", "x | y", "| a | b |", "|---|---|", " | 1 | 2 | ", "", "outro", "| z |"])
    got = corpus.table_aware_chunks(spark.createDataFrame([("d", text)], "k string, text string"), "k").orderBy("chunk_id").collect()
    assert [(r["chunk_id"], r["type"]) for r in got] == [(1, "text"), (2, "table"), (3, "text"), (4, "table")]
    assert got[1]["page_content"] == "intro\n| a | b |\n|---|---|\n | 1 | 2 | \noutro" and got[3]["page_content"] == "outro\n| z |"


def test_html():
    got = html.to_markdown("<html><style>p{}</style><h2>Head</h2><p>a <b>bold</b> <a href='/x'>link</a><br>next</p><ul><li>one</li><li>two</li></ul><script>no()</script></html>")
    assert got == "## Head\n\na **bold** [link](/x)  \nnext\n\n* one\n* two"
    assert html.to_markdown("plain text") == "plain text" and html.to_markdown(None) is None


def test_uploads(spark):
    rows = [("dir/a.html", "<h1>T</h1> body"), ("../b.html", "x"), ("", "x"), (None, "x")]
    got = corpus.process_uploads(spark.createDataFrame(rows, "filename string, text string")).collect()
    assert [r["status"] for r in got] == ["success", "error", "error", "error"]
    assert got[0]["stored_name"].startswith("a_") and len(got[0]["stored_name"]) == len("a_12345678.md") and got[0]["markdown"].startswith("# T")


def test_fingerprint_ignores_order_and_sees_changes(spark):
    rows = [("s", f"text {i}", "m") for i in range(40)] + [("t", "x", None)]
    schema = "source string, page_content string, meta string"
    a, b = spark.createDataFrame(rows, schema), spark.createDataFrame(random.Random(1).sample(rows, len(rows)), schema).repartition(3)
    assert corpus.corpus_fingerprint(a).first() == corpus.corpus_fingerprint(b).first()
    c = spark.createDataFrame(rows[:-1] + [("u", "x", None)], schema)
    changes = {r["source"]: r["change"] for r in corpus.detect_changes(corpus.source_fingerprints(a), corpus.source_fingerprints(c)).collect()}
    assert changes == {"s": "same", "t": "removed", "u": "added"}
    assert [r[0] for r in corpus.changed_sources(corpus.source_fingerprints(a), corpus.source_fingerprints(c)).collect()] == ["u"]


def test_fingerprints_add_and_remove(spark):
    """Equal for any order and grouping of updates; what is added and taken away leaves the old value; repeats and nulls count."""
    schema = "source string, page_content string, meta string"
    rows = [("s", f"text {i}", "m") for i in range(30)] + [("t", "x", None), ("t", "x", None), ("t", None, "m"), ("t", "", "m"), (None, "n", "m")]
    frame = lambda rows: spark.createDataFrame(rows, schema)
    prints = lambda sums: {tuple(r) for r in corpus.sums_fingerprint(sums).collect()}
    whole = corpus.multiset_sums(frame(rows))
    assert prints(corpus.multiset_sums(frame(random.Random(2).sample(rows, len(rows))).repartition(5))) == prints(whole)
    less = corpus.updated_sums(whole, frame([("u", "new", "m")]), frame([*rows[:10], rows[30]]))
    assert prints(less) == prints(corpus.multiset_sums(frame([*rows[10:30], *rows[31:], ("u", "new", "m")]))) != prints(whole)
    assert prints(corpus.updated_sums(less, frame([*rows[:10], rows[30]]), frame([("u", "new", "m")]))) == prints(whole)
    assert len({p for _, p, _ in prints(corpus.multiset_sums(frame([(str(i), *r) for i, r in enumerate([(None, "m"), ("", "m"), ("", None), ("m", ""), ("x", "m"), ("x:1", "m")])])))}) == 6
    changes = {r["source"]: r["change"] for r in corpus.detect_changes(corpus.sums_fingerprint(whole.dropna()), corpus.sums_fingerprint(less.dropna())).collect()}
    assert changes == {"s": "changed", "t": "changed", "u": "added"}
    assert corpus.updated_sums(whole, frame([]), frame(rows)).count() == 0


def test_corpus_checks(spark):
    empty = spark.createDataFrame([], "source string, page_content string")
    assert corpus.validate_corpus(empty, 3).first()["reason"] == "empty"
    two = spark.createDataFrame([("s", "x"), ("s", None)], "source string, page_content string")
    assert corpus.validate_corpus(two, 3).first()["n_missing"] == 1 and not corpus.validate_corpus(two.limit(1), 3).first()["valid"]
    assert tuple(corpus.index_alignment(spark.range(3).toDF("doc_id"), spark.range(1, 5).toDF("doc_id")).first()) == (1, 2, False)


# --- retrieval ------------------------------------------------------------------------------------------------------------------


def test_tokens(spark):
    assert bm25.cjk_bigrams("不锈钢 abc钢") == ["不锈", "锈钢", "abc", "钢"]
    df = one(spark, t="  Das  ist　gut\n")
    assert df.select(bm25.tokenize(F.col("t"))).first()[0] == ["Das", "ist", "gut"]
    assert df.select(bm25.tokenize_zh(F.lit("钢筋 的 价格"), frozenset({"的"}))).first()[0] == ["钢筋", "价格"]


def test_bm25_by_brute_force(spark):
    rng = random.Random(2)
    docs = [(i, [rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))]) for i in range(40)]
    queries = [(i, [rng.choice("abcdefghz") for _ in range(4)]) for i in range(6)]
    schema = "long, tokens array<string>"
    index = bm25.build_index(spark.createDataFrame(docs, f"doc_id {schema}"))
    avgdl = sum(len(t) for _, t in docs) / len(docs)
    df = {w: sum(w in t for _, t in docs) for w in "abcdefgh"}
    raw = {w: np.log(40 - n + 0.5) - np.log(n + 0.5) for w, n in df.items() if n}
    mean = sum(raw.values()) / len(raw)
    idf = {w: x if x >= 0 else 0.25 * mean for w, x in raw.items()}
    for pad in (False, True):
        got = bm25.search(spark.createDataFrame(queries, f"query_id {schema}"), index, 10, pad).collect()
        for q, words in queries:
            scores = [(round(sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) for w in words), 6), d) for d, t in docs]
            want = sorted(((s, d) for s, d in scores if s > 0 or pad), key=lambda x: (-x[0], x[1]))[:10]
            mine = sorted((r["rank"], r["doc_id"], r["score"]) for r in got if r["query_id"] == q)
            assert [d for _, d, _ in mine] == [d for _, d in want] and np.allclose([s for *_, s in mine], [s for s, _ in want], atol=2e-6)


def test_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 40)).astype(np.float32)
    v = spark.createDataFrame([(i, [float(a) for a in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")
    q = v.filter("vec_id < 7").withColumnRenamed("vec_id", "query_id")
    d = np.sqrt(((x[:7, None].astype(float) - x[None].astype(float)) ** 2).sum(2)).round(6)
    want = {(i, j, n + 1) for i in range(7) for n, j in enumerate(np.lexsort((np.arange(200), d[i]))[:5])}
    assert {(r["query_id"], r["vec_id"], r["rank"]) for r in vectors.knn_exact(q, v, 5, block=3).collect()} == want
    celled, centres = vectors.build_ivf(v, 8)
    near = {(r["query_id"], r["vec_id"], r["rank"]) for r in vectors.knn_ivf(q, celled, centres, 5, nprobe=8).collect()}
    assert near == want
    some = {(r["query_id"], r["vec_id"]) for r in vectors.knn_ivf(q, celled, centres, 5, nprobe=4).collect()}
    assert len(some & {w[:2] for w in want}) >= 0.5 * len(want)
    mean, matrix = vectors.fit_whitening(v, 40)
    white = np.array([r["embedding"] for r in vectors.apply_whitening(v, mean, matrix).collect()])
    assert np.allclose(np.cov(white.T), np.eye(40), atol=1e-4)
    short = v.select(vectors.truncate_dims(F.col("embedding"), 4).alias("e"), vectors.truncate_dims(F.col("embedding"), 64).alias("w")).first()
    assert len(short["e"]) == 32 and len(short["w"]) == 40 and abs(sum(a * a for a in short["e"]) - 1) < 1e-6
    assert one(spark, z=1).select(vectors.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))).first()[0] == [0.0, 0.0]


def test_embedding_failures_are_marked(spark):
    def broken():
        def encode(texts):
            raise RuntimeError("no model")

        return encode

    df = spark.createDataFrame([(1, "a\nb"), (2, None)], "i int, text string")
    good, bad = vectors.embed_texts(df).collect(), vectors.embed_texts(df, make_encoder=broken).collect()
    assert [r["ok"] for r in good] == [True, False] and [r["ok"] for r in bad] == [False, False] and not any(bad[0]["embedding"])
    assert vectors.embed_texts(df.limit(0)).count() == 0


def test_merge_rerank_context(spark):
    rows = [(1, "a b", "emb", 1, 7, "x"), (1, "a b", "bm25", 1, 8, "a b c"), (1, "a b", "bm25", 2, 7, "x"), (2, " ", "bm25", 1, 1, "p"), (2, " ", "bm25", 2, 2, "q")]
    c = spark.createDataFrame(rows, "query_id long, query string, method string, rank int, doc_id long, page_content string")
    assert [(r["query_id"], r["doc_id"], r["rank"]) for r in ranking.hybrid_merge(c, ("bm25", "emb")).orderBy("query_id", "rank").collect()] == [(1, 8, 1), (1, 7, 2), (2, 1, 1), (2, 2, 2)]
    ranked = ranking.rerank(ranking.hybrid_merge(c), 1).orderBy("query_id").collect()
    assert [(r["doc_id"], r["rerank_score"] is None) for r in ranked] == [(8, False), (1, True)]
    assert ranking.build_contexts(ranking.hybrid_merge(c)).orderBy("query_id").first()["context"] == "a b c\nx"
    shown = ranking.reference_docs(spark.createDataFrame([(1, 1, "", "t"), (1, 2, "f.md", "u")], "query_id long, rank int, source string, page_content string")).collect()
    assert [r["filename"] for r in shown] == ["文档片段 1", "f.md"]

    def broken():
        return lambda q, p: 1 / 0

    assert {(r["rerank_score"], r["ok"]) for r in ranking.score_pairs(c, broken).collect()} == {(0.0, False)}


# --- prices ---------------------------------------------------------------------------------------------------------------------


def test_volume(spark):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([100, 101, 1000, 1001, 10_000, 100_000, 1_000_000])], "query_id long, total_count long")
    got = [(r["estimated_tokens"], r["level"], r["can_process"]) for r in prices.volume_report(counts).orderBy("query_id").collect()]
    assert got == [(12_000, "optimal", True), (12_120, "acceptable", True), (120_000, "acceptable", True), (120_120, "too_large", False), (1_200_000, "too_large", False), (12_000_000, "unacceptable", False), (120_000_000, "unacceptable", False)]
    asked = spark.createDataFrame([(1, "x")], "query_id long, materialName string").select("*", *[F.lit(None).cast("string").alias(f) for f in ("province", "city", "materialModelSpec")])
    assert prices.suggest_filters(asked, spark.createDataFrame([(1, 50_000)], "query_id long, total_count long")).first()["suggested"] == ["province", "city", "materialModelSpec"]


def test_rebuild_only_what_changed(spark, tmp_path):
    def files_of(*rows):
        return spark.createDataFrame(rows, "path string, source string, text string")

    chunks = lambda n: sorted((r["metadata"]["source"], r["metadata"]["chunk_id"], r["page_content"]) for r in stores.read_rebuilt(spark, f"{tmp_path}/r", n).collect())
    changes = lambda df: {r["source"]: r["change"] for r in df.collect()}
    a, b, c = ("x/a.md", "a.md", "one\n| t |\ntwo"), ("b.md", "b.md", "bee"), ("c.md", "c.md", "sea")
    assert changes(stores.rebuild_corpus(files_of(a, b), f"{tmp_path}/r")) == {"a.md": "added", "b.md": "added"}
    assert chunks(1) == [("a.md", 1, "one"), ("a.md", 2, "one\n| t |\ntwo"), ("a.md", 3, "two"), ("b.md", 1, "bee")]
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "r/chunks/rebuild=1/source=a.md").glob("*.parquet")}
    assert changes(stores.rebuild_corpus(files_of(a, ("b.md", "b.md", "bees"), c), f"{tmp_path}/r", 1)) == {"a.md": "same", "b.md": "changed", "c.md": "added"}
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "r/chunks/rebuild=1/source=a.md").glob("*.parquet")} == before
    assert ("b.md", 1, "bees") in chunks(2) and ("c.md", 1, "sea") in chunks(2) and len(chunks(2)) == 5
    assert changes(stores.rebuild_corpus(files_of(a), f"{tmp_path}/r", 2)) == {"a.md": "same", "b.md": "removed", "c.md": "removed"}
    assert len(chunks(3)) == 3


def test_rebuild_leaves_nothing_stale_or_lost(spark, tmp_path):
    """A source that becomes empty has no chunks; sources without a name are kept; text files are split otherwise than Markdown."""
    long = "word " * 150
    rows = [("1", "a.md", "one"), ("2", "", "nameless"), ("3", None, "null"), ("4", "t.txt", f"| not | a table |\n\n{long}"), ("5", "m.md", "| a | table |"), ("6", None, "")]
    files_of = lambda rows: spark.createDataFrame(rows, "path string, source string, text string")
    chunks = lambda n: sorted((r["metadata"]["source"], r["metadata"]["type"], r["page_content"]) for r in stores.read_rebuilt(spark, f"{tmp_path}/r", n).collect())
    stores.rebuild_corpus(files_of(rows), f"{tmp_path}/r")
    split = [("t.txt", "text", c) for c in splitting.recursive_split(rows[3][2])]
    want = [("m.md", "table", "| a | table |"), *split, ("unknown", "text", "nameless"), ("unknown", "text", "null")]
    assert len(split) > 2 and chunks(1) == sorted([("a.md", "text", "one"), *want])
    assert {r["source"]: r["change"] for r in stores.rebuild_corpus(files_of([("1", "a.md", ""), *rows[1:]]), f"{tmp_path}/r", 1).collect()} == {"a.md": "changed", "unknown": "same", "t.txt": "same", "m.md": "same"}
    assert chunks(2) == sorted(want)
    # done again after a failure, and rebuilt when the text is back
    stores.rebuild_corpus(files_of([("1", "a.md", ""), *rows[1:]]), f"{tmp_path}/r", 1)
    stores.rebuild_corpus(files_of(rows), f"{tmp_path}/r", 2)
    assert chunks(2) == sorted(want) and chunks(3) == sorted([("a.md", "text", "one"), *want])


def test_files_of_one_name_stay_apart(spark):
    """Two files of three lines each; none takes lines or context of the other."""
    rows = [("a/x.md", "x.md", "first\n| 1 |\nlast"), ("b/x.md", "x.md", "start\n| 2 |\nend"), ("c", None, "p\n| 3 |"), ("d", None, "q\n| 4 |")]
    want = [("unknown", 1, "p"), ("unknown", 1, "q"), ("unknown", 2, "p\n| 3 |"), ("unknown", 2, "q\n| 4 |"), ("x.md", 1, "first"), ("x.md", 1, "start"), ("x.md", 2, "first\n| 1 |\nlast"), ("x.md", 2, "start\n| 2 |\nend"), ("x.md", 3, "end"), ("x.md", 3, "last")]
    with_path = spark.createDataFrame(rows, "path string, source string, text string")
    for table in (with_path, with_path.drop("path")):
        got = corpus.table_aware_documents(table).collect()
        assert sorted((r["metadata"]["source"], r["metadata"]["chunk_id"], r["page_content"]) for r in got) == want
        assert len({r["doc_id"] for r in got}) == len(got)


def test_older_names_of_date_bounds(spark):
    records = spark.createDataFrame([("r1", "information_price", "steel", 5.0, "2023-05-01"), ("r2", "information_price", "steel", 5.0, "2024-05-01"), ("r3", "information_price", None, 5.0, "2024-06-01")], "record_id string, channel string, materialName string, price double, releaseDate string")
    rows = [(1, "steel", None, "2024-01-01"), (2, "steel", "", "2024-01-01"), (3, "steel", "2023-01-01", "2024-01-01"), (4, "", None, "2024-01-01"), (5, "steel", None, None)]
    queries = spark.createDataFrame(rows, "query_id long, materialName string, startReleaseDate string, startReleaseTime string")
    queries = queries.withColumns({"channel": F.lit("information_price"), **{c: F.lit(None).cast("string") for c in ("endReleaseDate", "materialModelSpec", "province", "city", "releaseDepartment", "brand", "supplyName", "grade")}})
    queries = queries.withColumns({c: F.lit(None).cast("double") for c in ("minPrice", "maxPrice")}).withColumn("matchMethod", F.lit(1))
    got = sorted((r["query_id"], r["record_id"]) for r in prices.filter_prices(records, queries).collect())
    assert got == [(1, "r2"), (2, "r2"), (3, "r1"), (3, "r2"), (4, "r2"), (4, "r3"), (5, "r1"), (5, "r2")]


def test_strict_statistics(spark):
    rows = spark.createDataFrame([(1, "t", "1"), (1, "t", "n/a"), (1, "m", "2"), (1, "m", " "), (1, "m", None)], "query_id long, unit string, price string")
    got = {r["unit"]: (r["valid_count"], r["invalid_count"], r["error"]) for r in analysis.price_stats(rows, strict=True).collect()}
    assert got == {"t": (0, 1, "分析失败: n/a"), "m": (1, 2, None)}
    assert {r["unit"]: r["valid_count"] for r in analysis.price_stats(rows).collect()} == {"t": 1, "m": 1}


def test_searches_pass_over_unusable_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, []), (5, [0.0, 1.0]), (6, [1.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.withColumnRenamed("vec_id", "query_id")
    want = [(1, 1, 1), (1, 5, 2), (5, 5, 1), (5, 1, 2), (6, 6, 1)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in vectors.knn_exact(q, v, 5).collect()) == sorted((a, r, b) for a, b, r in want)
    alike = v.filter("vec_id <> 6")
    celled, centres = vectors.build_ivf(alike, 2)
    assert sorted((r["query_id"], r["vec_id"]) for r in vectors.knn_ivf(alike.withColumnRenamed("vec_id", "query_id"), celled, centres, 5, 2).collect()) == [(1, 1), (1, 5), (5, 1), (5, 5)]


def test_channel_reasons(spark):
    """The texts as the service words them."""
    rows = [(1, "请问信息价", None, None), (2, "询价 报价单", "b", None), (3, "走势", None, "m"), (4, "hello", None, None)]
    q = spark.createDataFrame(rows, "question_id long, question string, brand string, materialName string").withColumns({c: F.lit(None).cast("string") for c in ("materialModelSpec", "startReleaseDate", "endReleaseDate")})
    inferred = routing.infer_channel(q, routing.keyword_table(spark))
    got = {r["question_id"]: (r["reason"], r["matched_keywords"]) for r in inferred.collect()}
    assert got[1] == ("根据关键词「信息价」明确识别", ["信息价"])
    assert got[2] == ("根据关键词「询价, 报价单, [实体特征]检测到品牌信息」推断", ["询价", "报价单", "[实体特征]检测到品牌信息"])
    assert got[3] == ("根据关键词「走势」推断", ["走势"]) and got[4] == ("无法识别查询渠道", [])
    told = {r["question_id"]: r["suggestion_text"] for r in routing.channel_suggestion(inferred).collect()}
    assert told[1] == "已识别渠道：信息价" and told[2] == "推断渠道：厂商报价（根据关键词「询价, 报价单, [实体特征]检测到品牌信息」推断）"


def test_ranges(spark):
    rows = [(1, None, 5.0, "", None), (2, 0.0, 5.0, "2024-01-01", "2024-01-02"), (3, 5.0, 5.0, "2024-01-01", "2024-01-01"), (4, -1.0, 5.0, "2024-13-01", "2024-01-02")]
    got = prices.validate_ranges(spark.createDataFrame(rows, "query_id long, minPrice double, maxPrice double, startReleaseDate string, endReleaseDate string")).orderBy("query_id").collect()
    assert [(r["price_ok"], r["date_ok"]) for r in got] == [(True, True), (True, True), (False, False), (False, False)]


def test_core_names(spark):
    names = ["Ｑ235B 热轧 钢板 2.0*1250*2500", "SUS304不锈钢板", "50mm", None, "", "  A,B  c]d "]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(fuzzy.core_name(F.col("n"))).collect()]
    assert got == ["钢板", "不锈钢板", "", "", "", "a,b c d"]
    assert one(spark, n="A,B_c").select(fuzzy.core_name(F.col("n"), "all")).first()[0] == "a b c"


def test_containment(spark):
    cases = [("ab", "xxabyy", 1.0), ("a b", "xaby", 0.5), ("a", "abc", 0.0), ("", "abc", 0.0), ("ab", "cd", 0.0), (None, "ab", 0.0)]
    both = [(a, b, s) for a, b, s in cases] + [(b, a, s) for a, b, s in cases]
    df = spark.createDataFrame(both, "a string, b string, s double")
    assert df.filter(fuzzy.containment(F.col("a"), F.col("b")) != F.col("s")).count() == 0


def test_fuzzy_match(spark):
    q = spark.createDataFrame([(1, "不锈钢板"), (2, "zz")], "query_id long, materialName string")
    names = ["304不锈钢板 2.0*1250*2500", "冷轧不锈钢板", "不锈钢卷 拉丝", "HRB400 螺纹钢 Φ12", "加工费", "冷轧不锈钢板", "50mm", None]
    m = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)] + [(2, 99, "qq")], "query_id long, i int, materialName string")
    got = {r["i"]: r["tag"] for r in fuzzy.fuzzy_match(q, m).collect()}
    assert got[0] == got[1] == got[5] == "keep" and not {3, 4, 6, 7, 99} & set(got)


def brute_tiers(x):
    x = sorted(x)
    n = len(x)
    if n < 4 or x[0] == x[-1]:
        return "single"
    cut = max((i for i in range(1, n) if x[i] > x[i - 1]), key=lambda i: (round(sum(x[:i]) ** 2 / i + sum(x[i:]) ** 2 / (n - i), 6), -i))
    left, right = x[:cut], x[cut:]

    def silhouette(v, own, other):
        if len(own) == 1:
            return 0
        a = sum(abs(v - w) for w in own) / (len(own) - 1)
        b = sum(abs(v - w) for w in other) / len(other)
        return (b - a) / max(a, b)

    s = (sum(silhouette(v, left, right) for v in left) + sum(silhouette(v, right, left) for v in right)) / n
    gap = (sum(right) / len(right) - sum(left) / len(left)) / (sum(x) / n)
    return "two-tier" if s >= 0.5 and gap >= 0.3 and min(len(left), len(right)) >= 0.1 * n else "single"


def test_price_analysis_by_brute_force(spark):
    rng = random.Random(3)
    groups = {0: [10, 10, 11, 11, 20, 20, 21, 21], 1: [5, 5, 5], 2: [7] * 6, 3: [1.0] * 9 + [100.0], 4: [3.5]}
    groups |= {5 + k: [rng.choice([10, 30]) + rng.randint(0, 5) for _ in range(rng.randint(4, 30))] for k in range(12)}
    rows = [(g, "t", str(float(x))) for g, xs in groups.items() for x in xs] + [(g, "t", bad) for g in groups for bad in ("", " ", "abc", "NaN", None)] + [(99, None, "x")]
    df = spark.createDataFrame(rows, "query_id long, unit string, price string")
    stats = {(r["query_id"], r["unit"]): r for r in analysis.price_stats(df.withColumn("unit", analysis.unit_of(F.col("unit")))).collect()}
    tiers = {r["query_id"]: r for r in analysis.price_tiers(df).collect()}
    assert stats[99, "UNKNOWN"]["error"] == "无有效价格数据"
    for g, xs in groups.items():
        x = np.array(xs, float)
        q1, q3 = np.quantile(x, [0.25, 0.75])
        kept = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
        r = stats[g, "t"]
        assert (r["total_count"], r["invalid_count"], r["valid_count"]) == (len(x) + 5, 5, len(kept))
        assert np.allclose([r["mean_price"], r["median_price"], r["std_price"]], [kept.mean(), np.median(kept), kept.std(ddof=1) if len(kept) > 1 else 0])
        assert (r["ci_low"] is None) == (len(kept) < 2)
        assert tiers[g]["mode"] == brute_tiers(xs), xs
        if tiers[g]["mode"] == "single":
            assert np.allclose(tiers[g]["prices"], [np.median(x)])
    assert list(tiers[0]["prices"]) == [10.5, 20.5] and tiers[1]["reason"] == "样本过少"


def test_units_and_histogram(spark):
    rows = [(1, "kg", 1.0), (1, "kg", 2.0), (1, "t", 3.0), (1, "t", 4.0), (1, "", 5.0)]
    df = spark.createDataFrame(rows, "query_id long, unit string, price double")
    assert {(r["unit"], r["unit_rank"]) for r in analysis.analyze_by_unit(df).collect()} == {("kg", 1), ("t", 2), ("UNKNOWN", 3)}
    assert analysis.most_common_unit_records(df).count() == 2
    prices_ = spark.createDataFrame([(1, "u", float(x)) for x in (0, 2, 4, 10, 10)] + [(2, "u", 5.0)], "query_id long, unit string, price double")
    bins = {(r["query_id"], r["bin"]): (r["label"], r["count"]) for r in analysis.price_histogram(prices_).collect()}
    assert [bins[1, b] for b in range(1, 6)] == [("0-2", 2), ("2-4", 1), ("4-6", 0), ("6-8", 0), ("8-10", 2)]
    assert sum(bins[2, b][1] for b in range(1, 6)) == 1


def test_series_and_table(spark):
    rows = [(1, "r1", "A|b\\c\nd", 5.0, "2024-01-31"), (1, "r2", "e", 0.0, "2024-01-01"), (1, "r3", "f", 7.0, None), (1, "r4", "g", 9.0, "2024-01-02")]
    df = spark.createDataFrame(rows, "query_id long, record_id string, materialName string, price double, releaseDate string")
    assert [tuple(r) for r in analysis.price_time_series(df, "releaseDate").collect()] == [(1, "2024-01", 2, 7.0, 5.0, 9.0)]
    full = df.select("*", *[F.lit("x").alias(c) for c in ("materialModelSpec", "brand", "unit", "province", "city")])
    queries = spark.createDataFrame([(1, "manufacturer_price"), (2, "zc_price")], "query_id long, channel string")
    table = {r["query_id"]: r["table"] for r in analysis.render_md_table(full, queries, 2).collect()}
    assert table[1].split("\n")[2] == "| 1 | A|b/c / d | x | x | 5.0 | x | x | x | 2024-01-31 |" and len(table[1].split("\n")) == 4 and "品牌" in table[1]
    assert table[2] == "⚠️ 没有查询到材料信息"


def test_recommendation(spark):
    records = spark.createDataFrame([(f"r{i}", "zc_price", "red widget", "7", "b", "t", "ASIA", "X", "2024-01-01", float(p)) for i, p in enumerate([10, 10, 11, 11, 20, 20, 21, 21])], "record_id string, channel string, materialName string, materialModelSpec string, brand string, unit string, province string, city string, releaseDate string, price double")
    asked = spark.createDataFrame([(1, "zhicheng", "red widget") + (None,) * 13, (2, "zc_price", "blue") + (None,) * 13], PRICE_QUERY)
    got = {r["query_id"]: r for r in recommend_prices(records, asked).collect()}
    assert got[1]["success"] and got[1]["mode"] == "two-tier" and got[1]["matched_count"] == 8 and list(got[1]["prices"]) == [10.5, 20.5]
    assert not got[2]["success"] and got[2]["total_count"] == 0


# --- routing and dialogue -------------------------------------------------------------------------------------------------------


def test_channels(spark):
    cases = [("今天的信息价", "information_price", 1.0), ("厂商报价多少", "manufacturer_price", 1.0), ("智诚", "zc_price", 1.0), ("智诚信息价", "information_price", 1.0), ("行情价", "zc_price", 1.1 / 1.5), ("参考价", "information_price", 0.4 / 1.5), ("nothing", "unknown", 0.0)]
    q = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "question_id long, question string").select("*", *[F.lit(None).cast("string").alias(f) for f in ("brand", "materialModelSpec", "materialName", "startReleaseDate", "endReleaseDate")])
    got = {r["question_id"]: r for r in routing.infer_channel(q, routing.keyword_table(spark)).collect()}
    for i, (_, channel, confidence) in enumerate(cases):
        assert got[i]["channel"] == channel and abs(got[i]["confidence"] - confidence) < 1e-6
    named = routing.infer_channel(q.filter("question_id = 6").withColumn("materialName", F.lit("m")), routing.keyword_table(spark)).first()
    assert (named["channel"], named["confidence"]) == ("information_price", 0.5) and named["suggestion"]
    told = {r["question_id"]: r["should_confirm"] for r in routing.channel_suggestion(routing.infer_channel(q, routing.keyword_table(spark))).collect()}
    assert told[5] and not told[0] and not told[6]


def test_model_outputs(spark):
    texts = ['```json\n{"a": "1", "b": null}\n```', 'json {"a": "x"}', "{broken", '{"a": "1", "b": "two', "// note\n{\"a\": \"1\"}", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(routing.parse_fenced_json(F.col("t")).alias("j"), routing.lenient_kv_parse(routing.unfenced(F.col("t"))).alias("l")).collect()
    assert [r["j"] for r in rows] == [{"a": "1", "b": None}, {"a": "x"}, {}, {}, {"a": "1"}, {}, {}]
    assert rows[0]["l"] == {"a": "1", "b": None} and rows[3]["l"]["a"] == "1" and rows[5]["l"] == {}
    label = lambda s: one(spark, s=s).select(routing.normalize_label(F.col("s"), ["price_recommendation", "other"], "other")).first()[0]
    assert [label(x) for x in (" other ", "it is price_recommendation!", "PRICE-RECOMMENDATION", "", "???")] == ["other", "price_recommendation", "price_recommendation", "other", "other"]
    merged = one(spark, z=1).select(routing.merge_entities(F.create_map(F.lit("a"), F.lit("1"), F.lit("c"), F.lit("")), F.create_map(F.lit("a"), F.lit(""), F.lit("b"), F.lit("2"), F.lit("d"), F.lit("3")), ["a", "b"])).first()[0]
    assert merged == {"a": "1", "b": "2"}


START = datetime(2024, 1, 1)
TURNS = "session_id string, turn int, ts timestamp, materialName string, province string, city string, materialModelSpec string, brand string, channel string, channel_confidence double"


def turn(session, n, seconds, channel=None, confidence=None, **fields):
    return (session, n, START + timedelta(seconds=seconds), *[fields.get(f) for f in dialogue.NAMES], channel, confidence)


ROWS = [
    turn("a", 1, 0, materialName="m"), turn("a", 2, 600, province="p", channel="zc_price", confidence=0.9), turn("a", 3, 1201, city="c"),
    turn("b", 1, 5, materialName="x", province="p"), turn("b", 2, 10, materialName="", channel="", city="c"), turn("b", 3, 15, materialName="y", materialModelSpec="s", brand="b", channel="zc_price", confidence=0.5), turn("b", 4, 20, channel="information_price", confidence=1.0),
]


def test_dialogue_replay(spark):
    got = {(r["session_id"], r["turn"]): r for r in dialogue.dialogue_response(dialogue.replay(spark.createDataFrame(ROWS, TURNS))).collect()}
    assert [got["a", n]["epoch"] for n in (1, 2, 3)] == [1, 1, 2]
    assert got["a", 3]["materialName"] is None and not got["a", 3]["is_complete"] and got["a", 3]["next_field"] == "materialName"
    assert got["b", 2]["materialName"] == "x" and got["b", 2]["missing"] == ["materialModelSpec", "brand"] and got["b", 2]["status"] == "collecting"
    assert got["b", 3]["status"] == "ready" and got["b", 3]["materialName"] == "y" and got["b", 4]["channel"] == "zc_price"
    assert got["b", 4]["quick_options"] == ["✅ 确认查询", "🔄 修改条件"]
    states = dialogue.replay(spark.createDataFrame(ROWS, TURNS))
    now = F.lit(START + timedelta(seconds=700))
    summary = {r["session_id"]: r for r in dialogue.session_summary(states, now).collect()}
    assert summary["b"]["history_count"] == 8 and summary["b"]["expires_in"] == -80 and summary["a"]["epoch"] == 2
    expired = {r["session_id"]: r["expired"] for r in dialogue.expire_sessions(spark.createDataFrame(ROWS, TURNS), now).collect()}
    assert expired == {"a": False, "b": True}


def test_history(spark):
    rows = [(k, t) for k in range(1, 12) for t in range(2 * k)]
    got = dialogue.trim_history(spark.createDataFrame(rows, "conv_id int, turn int")).groupBy("conv_id").count().orderBy("conv_id").collect()
    assert [r["count"] for r in got] == [2, 4, 6, 8, 10, 6, 8, 10, 6, 8, 10]


def test_stream_equals_replay(spark, tmp_path):
    turns = spark.createDataFrame(ROWS, TURNS)
    for k in range(2):  # two files, so the second batch finds state
        turns.orderBy("ts").filter(F.col("ts") < F.lit(START + timedelta(seconds=12)) if k == 0 else F.col("ts") >= F.lit(START + timedelta(seconds=12))).coalesce(1).write.json(f"{tmp_path}/in{k}")
    (tmp_path / "all").mkdir()
    for k in range(2):
        for p in (tmp_path / f"in{k}").glob("*.json"):
            p.rename(tmp_path / "all" / f"{k}.json")
    from graintable.sources.files import read_turns_stream

    stream = read_turns_stream(spark, f"{tmp_path}/all", turns.schema, 1)
    out = dialogue.stream_dialogue(stream)
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    names = ["session_id", "turn", "epoch", *dialogue.NAMES, "channel", "channel_confidence", "missing", "status", "is_complete"]
    plain = lambda df: sorted((tuple(map(str, r)) for r in df.select(*names).collect()))
    assert plain(spark.read.parquet(f"{tmp_path}/out")) == plain(dialogue.replay(turns))


def test_request_metrics(spark):
    rows = [(START, "chat", 100, 0.1, 2.0), (START + timedelta(minutes=5), "chat", 50, 0.3, 0.0), (START + timedelta(hours=2), "chat", 10, 0.1, 1.0)]
    got = dialogue.request_metrics(spark.createDataFrame(rows, "ts timestamp, kind string, output_tokens long, ttft_s double, total_s double")).orderBy("window_start").collect()
    assert [(r["requests"], r["tokens_per_s"]) for r in got] == [(2, 50.0), (1, 10.0)]


# --- plans ----------------------------------------------------------------------------------------------------------------------


def test_plans_stay_native(spark):
    from graintable.plans import dialogue_queries, price_queries

    for q in (price_queries.filter_prices, price_queries.price_tiers, price_queries.price_stats, dialogue_queries.dialogue_status):
        plan = q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "Python" not in plan and "Pandas" not in plan
