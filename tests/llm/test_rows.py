"""Sharding, mixing, URL filters, exact dedup and top-k against SQL and brute force, odd cases included."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graintable.llm import exact_dedup, mixing, sharding, topk, url_filters

from .conftest import ROWS, same, write

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("where", [SF, "odd", "empty"])
def test_sharding_matches_sql(spark, where, request):
    d = where if where == SF else request.getfixturevalue(where)
    same(sharding.op1_sharding(spark, d), d, sharding.ORACLE_SQL)


def test_sharding_moves_rows_only_into_the_new_shard(spark):
    rows = sharding.op1_sharding(spark, SF).collect()
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows)
    for shard in range(8):
        own = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert own == list(range(len(own)))


def test_shards_follow_their_weights(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    counts = Counter(r["shard"] for r in sharding.assign_shards(ids, "doc_id", [1, 2, 0, 1]).collect())
    assert counts[2] == 0 and abs(counts[1] / 20_000 - 0.5) < 0.02 and abs(counts[0] / 20_000 - 0.25) < 0.02
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("doc_id"), [0, 0])


def test_crc_and_size(spark, odd):
    for r in sharding.op1_sharding(spark, odd).collect():
        if r["doc_id"] is not None:
            text = (next(x[1] for x in ROWS if x[0] == r["doc_id"]) or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(text) + 1, zlib.crc32(text))


@pytest.mark.parametrize("where", [SF, "odd", "empty"])
def test_mixing_matches_sql(spark, where, request):
    d = where if where == SF else request.getfixturevalue(where)
    same(mixing.op4_mixing(spark, d), d, mixing.ORACLE_SQL)


def test_mixing_by_brute_force(spark):
    rows = mixing.op4_mixing(spark, "/root/testdata/sf0.01").collect()
    sources = {}
    for r in rows:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        s = sources.setdefault((r["source_size"], r["target"]), [0, 0])
        s[0] += r["size"]
        s[1] += r["taken"]
    total = sum(size for size, _ in sources)
    assert math.isclose(sum(t for _, t in sources), 1.5 * total)
    for (size, target), (own, taken) in sources.items():
        assert own == size and target <= 2 * size and abs(taken - target) <= max(r["size"] for r in rows)


def test_mixing_rows_without_keys(spark):
    """Sources whose keys are null or all the same come near their targets too."""
    rows = [(None, f"text {i} " * 5, "a") for i in range(400)] + [(7, f"text {i} " * 5, "b") for i in range(400)] + [(i, "plain words " * 5, "c") for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert len(got) == 3 and all(abs(r["taken"] - r["target"]) <= 20 for r in got)


def test_mixing_equal_rows(spark, tmp_path, monkeypatch):
    """A source of equal rows comes near its target, as SQL says."""
    monkeypatch.setattr(mixing, "CHUNK", 30)
    rows = [(7, "one two three", "en", "a", 13)] * 400 + [(None, None, "en", "b", 0)] * 5 + [(None, "x y", "en", "b", 3)] * 100
    d = write(spark, tmp_path, rows)
    got = mixing.op4_mixing(spark, d).collect()
    for size, target in {(r["source_size"], r["target"]) for r in got}:
        taken = sum(r["taken"] for r in got if r["source_size"] == size)
        assert abs(taken - target) <= 3
    assert len(got) == 505
    same(mixing.op4_mixing(spark, d), d, mixing.ORACLE_SQL)


def test_targets_reshare_the_excess(spark):
    totals = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 20), (None, 30)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(totals).collect()}
    weights, most, target = {"a": 3, "b": 1, "c": 2, None: 3}, {"a": 20, "b": 2000, "c": 40, None: 60}, dict.fromkeys(("a", "b", "c", None), 0.0)
    left = 1.5 * 1060
    while left > 1e-9:  # dealt by weight, the excess dealt again
        free = [s for s in target if target[s] < most[s]]
        share, left = left, 0.0
        w = sum(weights[s] for s in free)
        for s in free:
            target[s] += share * weights[s] / w
            left += max(0.0, target[s] - most[s])
            target[s] = min(target[s], most[s])
    assert all(math.isclose(got[s], target[s]) for s in target)


def test_mixed_rows_take_effect(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    copies = Counter(r["doc_id"] for r in out.collect())
    for r in mixing.mix(docs.filter("doc_id <> 14")).collect():
        if r["size"] and r["doc_id"] is not None:
            assert copies[r["doc_id"]] in (0, 1, 2)


@pytest.mark.parametrize("where", [SF, "odd", "empty"])
def test_exact_dedup_matches_sql(spark, where, request):
    d = where if where == SF else request.getfixturevalue(where)
    same(exact_dedup.op2_exact_dedup(spark, d), d, exact_dedup.ORACLE_SQL)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 300, 20_000])
def test_fuse_filters_have_no_false_negatives(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
    blob = exact_dedup.build_filter(keys)
    assert exact_dedup.may_contain(blob, keys).all()
    others = np.random.default_rng(n + 1).integers(0, 2**63, 20_000).astype(np.uint64)
    assert exact_dedup.may_contain(blob, others).mean() < 0.01
    assert n < 1000 or len(blob) < 1.4 * n


def test_a_snapshot_serves_many_batches(spark, tmp_path):
    """Written once, then only read; batches with null and repeated keys, and a snapshot without rows."""
    frame = lambda rows: spark.createDataFrame(rows, "key long, text string")
    old = [(3, "one  text"), (4, "one text"), (9, "two"), (None, "three"), (9, "four"), (None, None)]
    exact_dedup.write_snapshot(frame(old), f"{tmp_path}/s")
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    for new in ([(1, "one\ttext"), (7, "five"), (7, "five"), (8, "")], [(None, "two"), (None, "three"), (7, "four"), (7, "one text"), (None, "six")]):
        groups = {}
        for side, rows in ((0, old), (1, new)):
            for key, text in rows:
                groups.setdefault(" ".join((text or "").split()), []).append((key, side))
        want = Counter()
        for members in groups.values():
            keep = min((k for k, _ in members if k is not None), default=None)
            want.update((k, side, keep, len(members)) for k, side in members)
        got = Counter((r["key"], r["side"], r["keep"], r["n"]) for r in exact_dedup.dedup_batches(frame(old), frame(new), f"{tmp_path}/s").collect())
        assert got == want
    assert {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")} == before
    assert {(r["key"], r["keep"], r["n"]) for r in exact_dedup.dedup_batches(frame([]), frame(old)).collect()} == {(3, 3, 2), (4, 3, 2), (9, 9, 1), (None, None, 1)}


def test_dropped_keys_are_copies(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    assert sorted(r[0] for r in exact_dedup.dropped(docs).collect()) == [2, 3, 5, 13]


@pytest.mark.parametrize("where", [SF, "empty"])
def test_url_filters_match_sql(spark, where, request):
    d = where if where == SF else request.getfixturevalue(where)
    same(url_filters.op10_url_filters(spark, d), d, url_filters.ORACLE_SQL)


def test_url_filters_follow_time_and_precedence(spark):
    entries = spark.createDataFrame(
        [("domain:bad.com", "2024-01-10", "block"), ("domain:bad.com", "2024-02-10", "withdraw"), ("host:ok.bad.com", "2024-01-15", "allow"), ("prefix:ok.bad.com/x/", "2024-01-20", "block"),
         ("host:tie.com", "2024-01-01", "allow"), ("host:tie.com", "2024-01-01", "block"), (None, "2024-01-01", "block"), ("host:n.com", None, "block")], "rule string, day string, action string"
    ).withColumn("day", F.to_date("day"))
    asked = [
        ("http://www.bad.com/a", "2024-01-09", "allow"), ("http://www.bad.com/a", "2024-01-10", "block"), ("http://www.bad.com/a", "2024-02-10", "allow"), ("http://ok.bad.com/y", "2024-01-16", "allow"),
        ("http://OK.bad.com/x/z?q", "2024-01-21", "block"), ("http://notbad.com/", "2024-01-21", "allow"), ("http://tie.com", "2024-01-02", "block"), (None, "2024-01-21", "allow"), ("", "2024-01-21", "allow"),
        ("http://user:pw@bad.com/x", "2024-01-10", "block"), ("http://user@BAD.com./x", "2024-01-10", "block"), ("http://bad.com@good.org/", "2024-01-10", "allow"), ("http://bad.com:8080", "2024-01-10", "block"),
        ("http://bad.com\\@good.org/", "2024-01-10", "block"), ("http://[::1]:80/x", "2024-01-10", "allow"), ("http://" + "a" * 50_000 + ".bad.com/" + "b/" * 2000, "2024-01-10", "block"), ("no address", "2024-01-21", "allow"), ("http://www.bad.com/a", None, "allow"), ("http://n.com/", "2024-05-01", "allow"), ("http://www.bad.com/a", "2024-01-10", "block"),
    ]
    captures = spark.createDataFrame([(i, u, f) for i, (u, f, _) in enumerate(asked)], "capture_id int, url string, fetched string").withColumn("fetched", F.to_date("fetched")).withColumn("rule", F.lit("clash"))
    got = {r["capture_id"]: r["verdict"] for r in url_filters.judge(captures, entries).collect()}
    assert got == {i: v for i, (_, _, v) in enumerate(asked)}


def test_url_filters_of_a_very_deep_path(spark):
    """Work grows with an address's length, not its square: 500,000 segments in one address, and a rule as deep as half of them."""
    deep = "http://h.org" + "/a" * 500_000
    half = "prefix:h.org" + "/a" * 250_000 + "/"
    entries = spark.createDataFrame([(half, "block"), ("prefix:h.org/a/a/", "allow"), ("prefix:h.org/a/b/", "block"), ("prefix:h.org/a", "block"), ("prefix:o.org/", "block"), ("prefix:nothing", "block"), ("prefix:", "block")], "rule string, action string").withColumn("day", F.to_date(F.lit("2024-01-01")))
    asked = [(1, deep), (2, "http://h.org" + "/a" * 250_000), (3, "http://h.org\\a\\a/?/b/"), (4, "http://h.org/a/a"), (5, "http://o.org"), (6, "http://o.org/x"), (7, None)]
    captures = spark.createDataFrame(asked, "capture_id int, url string").withColumn("fetched", F.to_date(F.lit("2024-02-01")))
    got = {r["capture_id"]: (r["verdict"], r["rule"] if r["rule"] != half else "half") for r in url_filters.judge(captures, entries).collect()}
    assert got == {1: ("block", "half"), 2: ("allow", "prefix:h.org/a/a/"), 3: ("allow", "prefix:h.org/a/a/"), 4: ("allow", None), 5: ("block", "prefix:o.org/"), 6: ("block", "prefix:o.org/"), 7: ("allow", None)}


@pytest.mark.parametrize("where", [SF, "empty"])
def test_topk_matches_sql(spark, where, request):
    d = where if where == SF else request.getfixturevalue(where)
    same(topk.op9_topk(spark, d), d, topk.ORACLE_SQL)


def test_topk_odd_vectors(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(300)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5, 0.5]) for i in range(300, 600)]  # many equal vectors
    rows += [(600, None), (620, [float("nan"), 1.0]), (640, [float("inf"), 1.0]), (660, [None, 1.0]), (680, []), (700, [3.0]), (720, [1e4, -1e4, 0.0]), (40, [1.0] * 5), (None, [1.0] * 5)]
    d = write(spark, tmp_path, rows, "vec_id long, embedding array<float>", False, "embeddings")
    usable = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    assert sum(i == 40 for i, _ in usable) == 2  # two queries of one id, each the other's candidate
    want = Counter()
    for n, (q, qv) in enumerate(usable):
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(qv, v, strict=False)), i) for m, (i, v) in enumerate(usable) if m != n)[:20]
            want.update((q, rank + 1, i, -s) for rank, (s, i) in enumerate(best))
    data = topk.quantised(spark.read.parquet(f"{d}/embeddings.parquet").withColumns({c: F.lit(1) for c in ("id", "v", "cell", "row", "n", "d")}), "vec_id", "embedding")
    for options in ({}, {"pivots": 3, "block": 16}):
        got = topk.top_k(data, data.filter("id % 20 = 0"), 20, **options).collect()
        assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want


def test_topk_repeated_rows(spark):
    """Of a query's six equal rows five are its nearest; the blocks of other cells must still be searched."""
    rows = [(0, [1000, 0])] * 6 + [(i, [500 + i, 10 * i]) for i in range(1, 6)]
    data = spark.createDataFrame(rows, "id long, v array<long>")
    got = topk.top_k(data, data.filter("id = 0"), 7, pivots=20).collect()
    want = [(rank, 0, 1_000_000) for rank in range(1, 6)] + [(6, 5, 505_000), (7, 4, 504_000)]
    assert Counter((r["rank"], r["vec_id"], r["score"]) for r in got) == Counter(want * 6)


def test_topk_rules_out_far_blocks(spark):
    """Tight clusters on a sphere: most blocks go to few query cells, and the answer is the plain one."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 6))
    centres *= 1000 / np.linalg.norm(centres, axis=1)[:, None]
    rows = [(i, [int(x) for x in centres[i % 20] + rng.normal(size=6)]) for i in range(2000)]
    data = spark.createDataFrame(rows, "id long, v array<long>")
    asked = data.filter("id % 20 = 0 OR id % 20 = 7")
    dealt, query_blocks, _, _ = topk.meetings(data, asked, 5, pivots=32, block=64)
    assert dealt.count() < 0.5 * query_blocks.select("cell").distinct().count() * len(rows) / 64
    m = np.array([v for _, v in rows])
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(data, asked, 5, pivots=32, block=64).collect()}
    for i in [r["id"] for r in asked.collect()]:
        scores = m @ m[i]
        best = [j for j in np.lexsort((np.arange(2000), -scores)) if j != i][:5]
        assert [got[i, n + 1] for n in range(5)] == [(j, scores[j]) for j in best]
