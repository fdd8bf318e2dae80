"""An index after updates against one built anew."""

import random

from pyspark.sql import functions as F

from graintable.operators import bm25
from graintable.sources import segments

TOKENS = "doc_id long, tokens array<string>"


def rounded(rows):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows)


def same_index(spark, path, last, corpus):
    """The tables and a search of the index equal those of a new build of ``corpus``."""
    want, got = bm25.build_index(spark.createDataFrame(sorted(corpus.items()), TOKENS)), segments.open_index(spark, path, last)
    for name, columns in (("postings", ["term", "doc_id", "tf"]), ("documents", ["doc_id", "dl"]), ("terms", ["term", "df", "idf"]), ("totals", ["n", "avgdl", "avg_idf"])):
        assert rounded(got[name].select(columns).collect()) == rounded(want[name].select(columns).collect()), name
    asked = spark.createDataFrame([(1, ["a", "b"]), (2, ["c", "z", "c"]), (3, ["e"])], "query_id long, tokens array<string>")
    assert rounded(bm25.search(asked, got, 5).collect()) == rounded(bm25.search(asked, want, 5).collect())


def words(draw):
    return [draw.choice("abcdefgh") for _ in range(draw.randint(0, 9))]


def test_updates_equal_new_builds(spark, tmp_path):
    """Added, changed, emptied, removed and added again, in several updates with merges between them."""
    draw, path, last = random.Random(4), f"{tmp_path}/index", 0
    corpus = {i: words(draw) for i in range(60)}
    last = segments.update_index(spark.createDataFrame(sorted(corpus.items()), TOKENS), path)
    same_index(spark, path, last, corpus)
    for step in range(3):
        changed = {i: words(draw) for i in draw.sample(range(80), 8)} | {3: []} | ({5: ["a", "a", "new"]} if step == 2 else {})
        gone = [i for i in draw.sample(range(90), 6) if i not in changed] + ([5] if step == 1 and 5 not in changed else [])
        removed = spark.createDataFrame([(i,) for i in [*gone, None]], "doc_id long")
        last = segments.update_index(spark.createDataFrame([*sorted(changed.items()), (None, ["null"])], TOKENS), path, removed, last)
        corpus = {i: t for i, t in corpus.items() if i not in gone} | changed
        same_index(spark, path, last, corpus)
        if step:
            small = segments.small_segments(spark, path, last, 0.5)
            assert small and 1 not in small
            last = segments.merge_segments(spark, path, last, small)
            assert segments.segments_of(spark, path, last) == [1, last]
            same_index(spark, path, last, corpus)
    last = segments.merge_segments(spark, path, last, segments.segments_of(spark, path, last))
    assert segments.segments_of(spark, path, last) == [last]
    same_index(spark, path, last, corpus)


def test_an_update_done_again(spark, tmp_path):
    """An update that failed before its manifest was written is repeated; earlier states stay readable."""
    path, first, second = f"{tmp_path}/index", {1: ["a"], 2: ["a", "b"]}, {2: ["c"], 3: ["e", "b"]}
    frame = lambda d: spark.createDataFrame(sorted(d.items()), TOKENS)
    assert segments.update_index(frame(first), path) == 1
    assert segments.update_index(frame({2: ["x"], 9: ["y"]}), path, last=1) == 2
    assert segments.update_index(frame(second), path, last=1) == 2
    same_index(spark, path, 2, first | second)
    same_index(spark, path, 1, first)
    assert segments.update_index(spark.createDataFrame([], TOKENS), path, last=2) == 3
    same_index(spark, path, 3, first | second)


def test_an_update_reads_no_postings(spark, tmp_path):
    """Nor does a search read the segments that a merge has replaced."""
    path = f"{tmp_path}/index"
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.array(F.lit("all"), F.concat(F.lit("w"), F.col("id") % 50)).alias("tokens"))
    segments.update_index(docs, path)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "index/postings/segment=1").rglob("*.parquet")}
    segments.update_index(docs.filter("doc_id = 7").withColumn("tokens", F.array(F.lit("all"))), path, last=1)
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "index/postings/segment=1").rglob("*.parquet")} == before
    assert spark.read.parquet(f"{path}/postings/segment=2").count() == 1 and spark.read.parquet(f"{path}/dead/update=2").count() == 1
    last = segments.merge_segments(spark, path, 2, [1, 2])
    assert last == 3 and spark.read.parquet(f"{path}/postings/segment=3").count() == 399
    plan = segments.open_index(spark, path, last)["postings"]._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "tf#" in line)
    assert "segment" in scan.split("PartitionFilters: [")[1].split("]")[0]


def test_sums_are_of_the_rows_as_written(spark, tmp_path):
    """Texts aren't cut into words once more for them."""
    cuts = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def cut(text):
        cuts.add(1)
        return text.split()

    rows = [(i, f"a b w{i}") for i in range(100)]
    tokens = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", cut("text").alias("tokens"))
    last = segments.update_index(tokens, f"{tmp_path}/index")
    assert 100 <= cuts.value <= 300  # with another pass 400
    same_index(spark, f"{tmp_path}/index", last, {i: t.split() for i, t in rows})
