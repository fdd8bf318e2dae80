"""Dialogues as a stream with timers, and the hand-over of ready dialogues to price recommendation.

``stream_sessions`` keeps one value and one event-time timer a session (RocksDB keeps them off the heap). When the watermark has passed
a session's last turn by more than ttl, the timer gives a row of status ``expired`` and drops the state, so state is bounded by the sessions that are
alive. Time to live of the state itself goes by processing time in Spark, which a replay of old turns would not reproduce; hence the timer.

``answer_dialogues`` writes each micro-batch to folders named by its number, states first, then answers for the dialogues that became ready in it. A batch
that is run again after a crash overwrites its own folders, and whether a dialogue was ready before is part of its state, so each dialogue is answered once.

Turns that the watermark has passed are dropped by Spark. A turn that is late but within the watermark is taken when it arrives, and doesn't
set the session's clock back. A session that returns after it was dropped starts at epoch 1 again.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..durable import durable
from ..plans.recommend import recommend_prices
from ..schemas import PRICE_QUERY
from .dialogue import NAMES, TTL_SECONDS

_TEXTS = ", ".join(f"{f} string" for f in NAMES)
STATE = f"epoch int, last_us long, {_TEXTS}, channel string, channel_confidence double, ready boolean"
SESSIONS = f"session_id string, turn int, ts timestamp, epoch int, {_TEXTS}, channel string, channel_confidence double, missing array<string>, status string, became_ready boolean"
COLUMNS = [c.split()[0] for c in SESSIONS.split(", ")]
RESULT = Row(*COLUMNS)
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
ANSWERS = (
    "session_id string, epoch int, turn int, ts timestamp, success boolean, message string, total_count long, matched_count long, level string, unit string, "
    "valid_count long, min_price double, max_price double, mean_price double, median_price double, table string"
)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def steps(turns: list[tuple], state: tuple | None, ttl_us: int) -> tuple[list[tuple], tuple]:
    """The state after each turn of one session, and the last as a tuple in the order of STATE. ``turns``: us, turn, ts, fields, channel, channel_confidence.
    A turn without a time comes first and lets no time pass. Turns of equal time and number are taken in the order of their values, so that reruns agree."""
    epoch, clock, *held, ready = state or (0, None, *[None] * (len(NAMES) + 2), False)
    out = []
    place = lambda t: (t[0] is not None, t[0] or 0, t[1] is None, t[1] or 0, [(v is not None, str(v)) for v in t[3:]])
    for us, number, ts, *given in sorted(turns, key=place):
        if epoch == 0 or (us is not None and clock is not None and us - clock > ttl_us):
            epoch, held, ready = epoch + 1, [None] * len(given), False
        if us is not None:
            clock = us if clock is None else max(clock, us)
        *fields, channel, confidence = given
        held[:-2] = [v or h for v, h in zip(fields, held, strict=False)]
        if channel and held[-2] is None:
            held[-2:] = channel, None if confidence is None or confidence != confidence else confidence
        missing = [f for f, v in zip(NAMES, held, strict=False) if v is None]
        became, ready = not missing and not ready, not missing
        out.append((number, ts, epoch, *held, missing, "collecting" if missing else "ready", became))
    return out, (epoch, clock, *held, ready)


def advance(turns: pd.DataFrame, state: tuple | None, ttl_us: int) -> tuple[pd.DataFrame, tuple]:
    """``steps`` of a table: turn, ts, fields, channel, channel_confidence."""
    us = turns["ts"].astype("datetime64[us]").astype("int64")
    plain = lambda c: turns[c].astype(object).where(turns[c].notna(), None)
    rows, state = steps(list(zip(us.where(turns["ts"].notna(), None), *[plain(c) for c in ("turn", "ts", *NAMES, "channel", "channel_confidence")], strict=True)), state, ttl_us)
    return pd.DataFrame(rows, columns=COLUMNS[1:]), state


class Sessions(StatefulProcessor):
    """Turns of a session in, its state after each out; a row of status ``expired`` when it has been idle for longer than ttl. Holds a session's turns of one micro-batch.

    A session has one timer as long as it has a state. Turns don't move it: when it fires too early, it is set again to when the session is due."""

    def __init__(self, ttl: float) -> None:
        self.ttl_us = int(ttl * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", STATE)

    def _due(self, last_us: int | None) -> int:
        # a turn exactly ttl after the last still belongs to the session
        return 0 if last_us is None else (last_us + self.ttl_us) // 1000 + 1

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        before = self.session.get()
        out, state = steps([(r["us"], r["turn"], r["ts"], *[r[f] for f in NAMES], r["channel"], r["channel_confidence"]) for r in rows], before and tuple(before), self.ttl_us)
        self.session.update(state)
        due, now = self._due(state[1]), timerValues.getCurrentWatermarkInMs()
        if before is not None and due <= now:  # its timer would end it in this batch
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if before is None or due <= now:
            self.handle.registerTimer(max(due, now + 1))
        for row in out:
            yield RESULT(key[0], *row)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        state = self.session.get()
        if state is None:
            return
        epoch, last_us, *values, _ = state
        if self._due(last_us) > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(self._due(last_us))
            return
        self.session.clear()
        missing = [f for f, v in zip(NAMES, values, strict=False) if v is None]
        yield RESULT(key[0], None, None if last_us is None else EPOCH + timedelta(microseconds=last_us), epoch, *values, missing, "expired", False)

    def close(self) -> None:
        pass


def stream_sessions(turns: DataFrame, ttl: float = TTL_SECONDS, late: str = "1 hour") -> DataFrame:
    """turns (a stream): session_id, turn, ts, the entity fields, channel, channel_confidence. The query must run with the RocksDB state store."""
    own = F.coalesce(F.col("session_id").cast("string"), F.concat(F.lit("new-"), F.xxhash64("turn", "ts").cast("string")))
    needed = turns.select(own.alias("session_id"), "turn", "ts", F.unix_micros("ts").alias("us"), *NAMES, "channel", "channel_confidence").withWatermark("ts", late)
    return needed.groupBy("session_id").transformWithState(Sessions(ttl), SESSIONS, "Append", "EventTime")


def price_queries_of(ready: DataFrame) -> DataFrame:
    """A price query of each ready dialogue; its query_id is a hash of session, epoch and turn."""
    given = {"query_id": F.xxhash64("session_id", "epoch", "turn"), **{c: F.col(c) for c in (*NAMES, "channel")}}
    return ready.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PRICE_QUERY])


def answers_of(ready: DataFrame, records: DataFrame) -> DataFrame:
    """ready: session_id, epoch, turn, ts, the entity fields, channel. One answer each, with the columns of ANSWERS.

    Dialogues that ask for the same share one query, so a thing that is often asked for meets its records once."""
    asks = [*NAMES, "channel"]
    # written: the recommendation reads its queries many times
    distinct = durable(price_queries_of(ready).groupBy(*[f.name for f in PRICE_QUERY if f.name != "query_id"]).agg(F.min("query_id").alias("query_id")), "questions")
    found = recommend_prices(records, distinct)
    question = distinct.select("query_id", *[F.col(c).alias(f"_{c}") for c in asks])
    asked = ready.select("session_id", "epoch", "turn", "ts", *asks)
    asked = asked.join(question, [asked[c].cast("string").eqNullSafe(question[f"_{c}"]) for c in asks])
    return asked.join(found, "query_id").select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(ANSWERS)])


def answer_dialogues(turns: DataFrame, records: DataFrame, folder: str, ttl: float = TTL_SECONDS, late: str = "1 hour", **trigger) -> StreamingQuery:
    """Starts the job: states of all turns under folder/states, one answer for each dialogue that becomes ready under folder/answers, its progress under folder/checkpoint. Start it again with the same folder to go on."""
    spark = turns.sparkSession
    spark.createDataFrame([], ANSWERS).write.mode("overwrite").parquet(f"{folder}/answers/batch=-1")

    def hand_over(batch: DataFrame, number: int) -> None:
        states = f"{folder}/states/batch={number}"
        batch.write.mode("overwrite").parquet(states)  # the stateful step runs once; answers read what it wrote
        ready = batch.sparkSession.read.schema(batch.schema).parquet(states).filter("became_ready")
        if not ready.isEmpty():
            answers_of(ready, records).write.mode("overwrite").parquet(f"{folder}/answers/batch={number}")

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:  # a query keeps the settings of its start
        writer = stream_sessions(turns, ttl, late).writeStream.outputMode("append").foreachBatch(hand_over).option("checkpointLocation", f"{folder}/checkpoint")
        return writer.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(PROVIDER, before)


def read_answers(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{ANSWERS}, batch long").parquet(f"{folder}/answers")
