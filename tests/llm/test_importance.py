"""Importance resampling against SQL and a plain computation."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graintable.llm import importance

from .conftest import ROWS, SCHEMA, same, write

SF = "/root/testdata/sf0.001"
TARGET = [(0, "The cat sat on the mat"), (1, "ein Wort und 日本語"), (2, None)]


def folder(spark, path, rows, target=TARGET, extra=True):
    spark.createDataFrame(target, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return write(spark, path, rows, extra=extra)


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain(rows, target, longest, percent=10, least=20, buckets=10_000):
    """rows: key and text. The rows of the result but for its rank, and the ranks of drawn keys."""
    features = lambda text: [" ".join(w[i : i + n]) for w in [words_of(text)] for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in rows for f in features(x)), Counter(bucket(f) for _, x in target for f in features(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for key, text in rows:
        f = features(text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append((key, len(words_of(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[1]))
    return out, [(*r, i + 1) for i, r in enumerate(able[: percent * len(able) // 100])]


@pytest.mark.parametrize("extra", [True, False])
def test_odd_rows_match_sql(spark, tmp_path, extra):
    d = folder(spark, tmp_path, ROWS + [(100 + i, f"{ROWS[8][1]} {i}", None, None, None) for i in range(40)], extra=extra)
    same(importance.op11_importance(spark, d), d, importance.ORACLE_SQL)


def test_empty_tables(spark, tmp_path):
    d = folder(spark, tmp_path, [], [])
    assert importance.op11_importance(spark, d).count() == 0
    same(importance.op11_importance(spark, d), d, importance.ORACLE_SQL)


def test_matches_sql_on_the_smallest_tables(spark):
    same(importance.op11_importance(spark, SF), SF, importance.ORACLE_SQL)


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_longer_features_by_brute_force(spark, longest):
    """N-grams never cross documents, whatever the batch holds."""
    rows = [(r[0], r[1]) for r in ROWS if r[0] != 11] + [(200 + i, f"Eins zwei {i} drei " * (i % 11)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = importance.resample(docs, spark.createDataFrame(TARGET, "item_id long, text string"), longest=longest, percent=40).collect()
    want, drawn = plain(rows, TARGET, longest, 40)
    assert Counter(tuple(r)[:5] for r in got) == Counter(want)
    assert sorted(tuple(r) for r in got if r["rank"] is not None) == sorted(drawn)


def test_slices_change_nothing(monkeypatch):
    texts = [(r[1] or "").encode() for r in ROWS]
    whole = importance.Grams(3, 997)(texts)
    import pyarrow as pa

    monkeypatch.setattr(importance, "SLICE", 100)
    parts = [importance.Grams(3, 997)(s) for s in importance._slices(pa.array(texts))]
    assert np.concatenate([p[0] for p in parts]).tolist() == whole[0].tolist()
    for k in range(3):
        assert sum(np.bincount(p[1][k][1], minlength=997) for p in parts).tolist() == np.bincount(whole[1][k][1], minlength=997).tolist()


def test_equal_rows_have_consecutive_ranks(spark, monkeypatch):
    monkeypatch.setattr(importance, "CHUNK", 7)
    rows = [(None, "a " * 25)] * 100 + [(5, "b " * 25)] * 100 + [(5, "b " * 26)] * 3
    docs = spark.createDataFrame(rows, SCHEMA.split(", lang")[0])
    got = importance.resample(docs, docs.limit(0), percent=75).filter("rank is not null").select("rank").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 153))


def test_towards_the_target(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.when(F.col("id") % 2 == 0, "steel price beam ").otherwise("cat dog mouse "), 10).alias("text"))
    target = spark.createDataFrame([("beam of steel " * 2000,)], "text string")  # the smoothing leaves little of a short target
    drawn = importance.resample(docs, target).filter("rank is not null")
    assert drawn.count() == 200 and drawn.filter("doc_id % 2 = 0").count() > 140
