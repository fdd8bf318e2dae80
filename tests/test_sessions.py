"""Dialogues as a stream: timers, late turns, restarts, and one answer for each dialogue that becomes ready."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from graintable.sources.files import read_turns_stream
from graintable.streaming import dialogue, sessions

START = datetime(2024, 1, 1)
TURNS = "session_id string, turn int, ts timestamp, materialName string, province string, city string, materialModelSpec string, brand string, channel string, channel_confidence double"
RECORDS = [(f"r{i}", "zc_price", "steel bar", "s", "b", "t", "p", "c", "2024-01-01", 100.0 + i) for i in range(6)]


def turn(session, n, seconds, channel=None, confidence=None, **fields):
    return (session, n, START + timedelta(seconds=seconds), *[fields.get(f) for f in dialogue.NAMES], channel, confidence)


ALL = {"materialName": "steel", "province": "p", "city": "c", "materialModelSpec": "s", "brand": "b"}
BATCHES = [
    [turn("a", 1, 0, materialName="steel", channel="zc_price", confidence=0.9), turn("b", 1, 10, "zc_price", 1.0, **ALL), turn("c", 1, 20, materialName="x")],
    [turn("a", 3, 120, city="c", materialModelSpec="s"), turn("a", 2, 60, province="p"), turn("b", 2, 130, brand="other")],
    [turn("a", 4, 200, brand="b"), turn("a", 5, 210, channel="information_price"), turn("d", 1, 9_000, materialName="late ones follow")],
    [turn("c", 2, 30, province="too late"), turn("d", 2, 9_100, city="q")],
    [turn("b", 3, 9_200, "zc_price", 1.0, **ALL)],
]


def deliver(folder, batches, first=0):
    for k, rows in enumerate(batches, first):
        path = folder / f"{k}.json"
        path.write_text("\n".join(json.dumps({c.split()[0]: (v.isoformat() if isinstance(v, datetime) else v) for c, v in zip(TURNS.split(", "), r, strict=True)}) for r in rows))
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))


@pytest.fixture(scope="module")
def records(spark):
    names = "record_id string, channel string, materialName string, materialModelSpec string, brand string, unit string, province string, city string, releaseDate string, price double"
    return spark.createDataFrame(RECORDS, names)


def test_advance_equals_replay(spark):
    rows = [turn("s", i, 37 * i * i % 5000 + i * 90, channel=["", None, "zc_price", "information_price"][i * 7 % 4], confidence=i / 100, **{dialogue.NAMES[i % 5]: ["", None, f"v{i}"][i * 3 % 4 % 3]}) for i in range(120)]
    rows.sort(key=lambda r: (r[2], r[1]))
    df = spark.createDataFrame(rows, TURNS)
    want = [(r["turn"], r["epoch"], *[r[f] for f in dialogue.NAMES], r["channel"], r["channel_confidence"], r["missing"], r["status"]) for r in dialogue.replay(df).orderBy("ts", "turn").collect()]
    table, state, got = df.toPandas(), None, []
    for at in range(0, 120, 17):
        out, state = sessions.advance(table.iloc[at : at + 17], state, 600_000_000)
        got += [tuple(r) for r in out[["turn", "epoch", *dialogue.NAMES, "channel", "channel_confidence", "missing", "status"]].astype(object).where(lambda x: x.notna(), None).itertuples(index=False)]
    assert got == want and len({r[1] for r in want}) > 2


def test_stopped_and_restarted_each_ready_dialogue_has_one_answer(spark, records, tmp_path, monkeypatch):
    source, folder = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    deliver(source, BATCHES[:3])
    stream = lambda: read_turns_stream(spark, str(source), spark.createDataFrame([], TURNS).schema, 1)
    plain, calls = sessions.answers_of, []

    def breaks_once(ready, records):
        calls.append(1)
        out = plain(ready, records)
        if len(calls) == 2:  # after a part of the work of the batch in which a is ready
            out.write.mode("overwrite").parquet(f"{folder}/answers/batch=2")
            raise RuntimeError("lost")
        return out

    monkeypatch.setattr(sessions, "answers_of", breaks_once)
    with pytest.raises(Exception, match="lost"):
        sessions.answer_dialogues(stream(), records, folder).awaitTermination()
    sessions.answer_dialogues(stream(), records, folder).awaitTermination()
    deliver(source, BATCHES[3:], 3)
    sessions.answer_dialogues(stream(), records, folder).awaitTermination()
    got = sorted((r["session_id"], r["turn"], r["success"], r["total_count"], r["median_price"]) for r in sessions.read_answers(spark, folder).collect())
    # a when its last field came; b at once, not again for another brand, and again as a new dialogue after it had expired
    assert got == [("a", 4, True, 6, 102.5), ("b", 1, True, 6, 102.5), ("b", 3, True, 6, 102.5)]
    states = spark.read.parquet(f"{folder}/states")
    assert states.filter("province = 'too late'").count() == 0
    gone = {r["session_id"]: r for r in states.filter("status = 'expired'").collect()}
    assert set(gone) == {"a", "b", "c"} and gone["c"]["ts"] == START + timedelta(seconds=20) and gone["a"]["channel"] == "zc_price" and gone["c"]["missing"] == list(dialogue.NAMES[1:])
    assert states.filter(F.col("session_id") == "a").filter("became_ready").count() == 1


def test_answers_of_the_tables_are_those_of_a_replay(spark):
    from graintable.plans import dialogue_queries as q
    from graintable.sources.prices import price_records

    d = "/root/testdata/sf0.001"
    records = price_records(spark, d)
    states = dialogue.replay(q.turns_asked(spark, d, records), q.TTL).filter("status = 'ready'")
    first = states.groupBy("session_id", "epoch").agg(F.min_by(F.struct("turn", "ts", *dialogue.NAMES, "channel"), F.struct("ts", "turn")).alias("s")).select("session_id", "epoch", "s.*")
    shown = ["session_id", "turn", "success", "total_count", "median_price"]
    plain = lambda df: sorted(tuple(r) for r in df.select(*shown).collect())
    want = plain(sessions.answers_of(first, records))
    assert want and plain(q.dialogue_answers(spark, d)) == want and all(n > 0 for *_, n, _ in want)


def test_dialogues_that_ask_for_the_same_share_a_query(spark, records, monkeypatch):
    plain, asked = sessions.recommend_prices, []

    def counted(records, queries):
        asked.append(queries.count())
        return plain(records, queries)

    monkeypatch.setattr(sessions, "recommend_prices", counted)
    rows = [(f"s{i}", 1, i, START, *(["steel", "p", "c", "s", "b"] if i % 3 else ["steel", "p", "c", "s", ""]), [None, "zc_price"][i % 2]) for i in range(60)]
    names = ", ".join(f"{n} string" for n in dialogue.NAMES)
    got = sessions.answers_of(spark.createDataFrame(rows, f"session_id string, epoch int, turn int, ts timestamp, {names}, channel string"), records).collect()
    assert asked == [4] and sorted(r["turn"] for r in got) == list(range(60))
    assert {(r["turn"] % 2, r["success"], r["total_count"]) for r in got} == {(0, False, 0), (1, True, 6)}


def test_turns_of_a_part_lie_in_several_files(spark, tmp_path):
    rows = [turn(f"s{i % 7}", i, 60 * i, materialName=f"v{i}") for i in range(400)]
    from graintable.plans.dialogue_queries import store_turns

    said = spark.createDataFrame(rows, TURNS).repartition(3)
    files = store_turns(said, str(tmp_path / "in"), turns_a_file=30)
    found = sorted((tmp_path / "in").glob("*.json"), key=lambda f: f.stat().st_mtime_ns)
    assert files == 3 and len(found) == 12
    places = [[json.loads(line)["turn"] // 100 for f in found[k : k + 3] for line in f.read_text().splitlines()] for k in range(0, 12, 3)]
    assert places == [[k] * 100 for k in range(4)]
    assert store_turns(said.limit(0), str(tmp_path / "none")) == 1 and store_turns(said, str(tmp_path / "one")) == 1


def test_a_turn_without_time_or_number_ends_nothing():
    given = [None] * 7
    out, state = sessions.steps([(10, None, "t", "x", *given[1:]), (5, 2, "t", *given), (None, 3, None, *given)], None, 100)
    assert [(r[0], r[2], r[3]) for r in out] == [(3, 1, None), (2, 1, None), (None, 1, "x")] and state[:2] == (1, 10)
    assert sessions.steps([(111, 4, "t", *given)], state, 100)[1][:3] == (2, 111, None)


def test_turns_of_equal_time_and_number_have_one_order():
    turns = [(10, 1, "t", name, *["p", "c", "s", "b"], channel, 0.5) for name, channel in (("x", "zc_price"), ("y", None), (None, "information_price"))]
    assert sessions.steps(turns, None, 100) == sessions.steps(turns[::-1], None, 100)
