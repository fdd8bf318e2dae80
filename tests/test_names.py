"""Names against names: substring pairs by a gram index, and the price filter over them."""

import random

import pytest
from pyspark.sql import functions as F

from graintable.operators import names, prices

from .test_operators import PRICE_QUERY


def frame(spark, column, strings):
    return spark.createDataFrame([("c", s) for s in strings] + [("d", s) for s in strings[:3]], f"channel string, {column} string").distinct()


@pytest.mark.parametrize("letters", ["ab", "abcdefg", "钢筋混凝土😀"])
def test_pairs_by_brute_force(spark, letters):
    draw = random.Random(len(letters))
    a = sorted({"".join(draw.choices(letters, k=draw.randint(0, 9))) for _ in range(150)})
    b = sorted({"".join(draw.choices(letters, k=draw.randint(0, 7))) for _ in range(150)})
    got = [tuple(r) for r in names.either_holds(frame(spark, "a", a), frame(spark, "b", b)).collect()]
    want = {(c, x, y) for c, xs, ys in (("c", a, b), ("d", a[:3], b[:3])) for x in xs for y in ys if x and y and (x in y or y in x)}
    assert len(got) == len(set(got)) and set(got) == want


def test_candidates_are_few(spark):
    """10,000 names and 10,000 names asked for: no more candidates than a few for each, though all share words."""
    draw = random.Random(1)
    kinds = ["steel", "pipe", "beam", "cement", "glass", "brick", "board", "cable"]
    a = sorted({f"{draw.choice(kinds)} {draw.choice(kinds)} {draw.randrange(10**6):06d}" for _ in range(10_000)})
    b = [f"{x.split()[1]} {x.split()[2]}" for x in draw.sample(a, 5_000)] + [f"{draw.choice(kinds)} {draw.randrange(10**6):06d}" for _ in range(5_000)]
    long, short = frame(spark, "l", a), frame(spark, "s", b)
    met, held = names.substring_candidates(short, long), names.substring_pairs(short, long)
    assert met.count() < 40 * len(a)  # all pairs would be 100 million
    want = {(x, y) for x in b for y in (a if len(x) < 12 else ())}
    whole = {y.split(" ", 1)[1]: [] for y in a}
    for y in a:
        whole[y.split(" ", 1)[1]].append(y)
    want = {(x, y) for x in b for y in whole.get(x, ())}
    assert {(r["s"], r["l"]) for r in held.filter("channel = 'c'").collect()} == want and len(want) >= 5_000


def test_filter_by_brute_force(spark):
    """Exact, fuzzy and absent names; null and empty names of records; case."""
    have = ["Steel Pipe", "steel", "PIPE", "", None, "pi", "p", "钢筋", "HRB400 钢筋", "tee"]
    want = ["steel pipe", "Steel", "", None, "pip", "P", "钢", "xHRB400 钢筋y", "zz", "tee"]
    records = spark.createDataFrame([(f"r{i}{c[0]}", c, n) for i, n in enumerate(have) for c in ("zc_price", "information_price")], "record_id string, channel string, materialName string")
    records = records.withColumn("price", F.lit(1.0)).withColumn("releaseDate", F.lit("2024-01-01"))
    asked = spark.createDataFrame([(i * 4 + m, "zc_price", w) + (None,) * 9 + (m or None, None, None, None)[:4] for i, w in enumerate(want) for m in (0, 1, 2)], PRICE_QUERY)
    got = sorted((r["query_id"], r["record_id"]) for r in prices.filter_prices(records, asked).collect())
    method = {r["query_id"]: r["matchMethod"] for r in asked.collect()}

    def met(name, w, m):
        if not w:
            return True
        if name is None:
            return False
        return name == w if m == 2 else name.lower() in w.lower() or w.lower() in name.lower()

    assert got == sorted((q, f"r{i}z") for q, m in method.items() for i, n in enumerate(have) if met(n, want[q // 4], m))


def test_no_join_by_channel_alone(spark):
    records = spark.createDataFrame([("r", "zc_price", "a", 1.0, "2024-01-01")], "record_id string, channel string, materialName string, price double, releaseDate string")
    asked = spark.createDataFrame([(1, "zc_price", "a") + (None,) * 13], PRICE_QUERY)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = prices.filter_prices(records, asked)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in plan.splitlines() if "Join" in line]
    # but for that of the one empty name a channel may have
    alone = [j for j in joins if "[channel#" in j and "," not in j[j.index("[channel#") : j.index("]", j.index("[channel#"))]]
    assert len(joins) > 5 and "NestedLoop" not in plan and "Cartesian" not in plan and len(alone) == 1
