"""Sessions cut into slices against the replay by windows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from graintable.streaming import dialogue, slices

START = datetime(2024, 1, 1)
TURNS = "session_id string, turn int, ts timestamp, materialName string, province string, city string, materialModelSpec string, brand string, channel string, channel_confidence double"
STATE = ["session_id", "turn", "epoch", *dialogue.NAMES, "channel", "channel_confidence", "missing", "next_field", "status", "can_query", "completed"]


def plain(df):
    return sorted(tuple(map(str, r)) for r in df.select(*STATE).collect())


def said(session, i, seconds):
    fields = {dialogue.NAMES[i * 5 % 7 % 5]: ["", None, f"v{i}"][i * 3 % 4 % 3]}
    return (session, i, None if seconds is None else START + timedelta(seconds=seconds), *[fields.get(f) for f in dialogue.NAMES], ["", None, None, "zc_price", "information_price"][i * 7 % 5], i / 100)


@pytest.fixture(scope="module")
def turns(spark):
    rows = [said("long", i, i * 100 + (700 if i % 90 > 80 else 0) + i // 150 * 1000) for i in range(600)]  # states of very different lengths
    rows += [said(f"s{s}", i, i * 400 + i * i * 10) for s in range(5) for i in range(20)]
    rows += [said("gap", i, i * 600 + (1 if i > 4 else 0)) for i in range(9)]  # exactly at the limit, then past it
    rows += [said("untimed", i, None if i < 3 else i) for i in range(6)]
    rows += [said(None, i, i) for i in range(3)] + [said("", i, i) for i in range(3)]
    return spark.createDataFrame(rows, TURNS)


@pytest.mark.parametrize("rows", [7, 60, 100_000])
def test_slices_equal_replay(spark, turns, rows):
    assert plain(slices.replay_sliced(turns, rows=rows)) == plain(dialogue.replay(turns))


def test_values_cross_many_slices(spark):
    """One state over all slices: the first turn's channel and the values of the first turns hold to the end."""
    first = [("s", 0, START, "m", "p", None, None, None, "zc_price", 0.5), ("s", 1, START, None, None, "c", None, None, "information_price", 1.0)]
    rows = first + [("s", i, START + timedelta(seconds=i), *[None] * 7) for i in range(2, 300)] + [("s", 300, START + timedelta(seconds=300), "n", *[None] * 6)]
    df = spark.createDataFrame(rows, TURNS)
    got = slices.replay_sliced(df, rows=10)
    assert plain(got) == plain(dialogue.replay(df))
    last = got.filter("turn = 300").first()
    assert (last["materialName"], last["province"], last["city"], last["channel"], last["channel_confidence"]) == ("n", "p", "c", "zc_price", 0.5)


def test_empty_and_extra_columns(spark, turns):
    assert slices.replay_sliced(turns.limit(0)).count() == 0
    more = turns.withColumn("end", F.lit("e")).withColumn("side", F.lit(1))
    got = slices.replay_sliced(more, rows=50)
    assert plain(got) == plain(dialogue.replay(turns)) and got.filter("end = 'e' and side = 1").count() == turns.count()


def test_a_million_turns_of_one_session_are_in_several_tasks(spark):
    n = 1_000_000
    i = F.col("id")
    fields = [F.when(i % 50_000 == k, F.concat(F.lit("v"), i)).alias(f) for k, f in enumerate(dialogue.NAMES)]
    # a pause after each 300,000 turns
    ts = F.timestamp_seconds(1_700_000_000 + i + F.floor(i / 300_000) * 1_000)
    turns = spark.range(n).select(F.lit("bot").alias("session_id"), i.cast("int").alias("turn"), ts.alias("ts"), *fields, F.when(i % 300_000 == 7, "zc_price").alias("channel"), F.lit(0.5).alias("channel_confidence"))
    ranges = slices._ranges(turns, slices.SLICE)
    sizes = [r["count"] for r in ranges.groupBy("_slice").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 2.5 * slices.SLICE and sum(sizes) == n
    digest = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("turn", "epoch", *dialogue.NAMES, "channel", "status").cast("decimal(20,0)"))).first()
    assert digest(slices.replay_sliced(turns)) == digest(dialogue.replay(turns))
