"""Replay of dialogues whose sessions may be very long: sessions are cut into slices, which are replayed side by side.

All turns are put in order of session and time by range, so a slice is the part of a session that lies in one range, and no task holds more than a range
whatever the length of a session. Each slice is replayed by itself; its summary is the time of its first and last turn, the number of states it starts, and its last
state. The summaries of a session, at most one for each range, are scanned in order. That tells each slice the number of its first state and what
earlier slices leave it: the last value of each field and the first channel.

Turns of equal time and number are taken in the order of a hash of their columns; only rows that are equal in every column can't be parted by a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable
from .dialogue import NAMES, TTL_SECONDS, dialogue_status, filled, missing_fields, named_sessions

SLICE = 100_000  # turns of a range, on average
ORDER = ["ts", "turn", "_tie"]


def _ranges(turns: DataFrame, rows: int) -> DataFrame:
    """Adds _slice, the number of the range a turn is in, in order of session and time. Written, as ranges are drawn anew whenever they are computed."""
    partitions = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), turns.count() // rows + 1)
    named = named_sessions(turns)
    tied = named.withColumn("_tie", F.xxhash64(*named.columns))
    return durable(tied.repartitionByRange(partitions, "session_id", *ORDER).withColumn("_slice", F.spark_partition_id()), "turn-slices")


def _parted(first: Column, before: Column, ttl: float) -> Column:
    """Whether a turn at ``first`` starts a new state after one at ``before``. A turn without a time always does, and so does the one after it."""
    gap = F.unix_micros(first) - F.unix_micros(before)
    return gap.isNull() | (gap > int(ttl * 1_000_000))


def _within(turns: DataFrame, ttl: float) -> DataFrame:
    """turns of _ranges. The state after each turn as if its slice were all there is, and _local, the number of the state, from 0."""
    inside = Window.partitionBy("session_id", "_slice").orderBy(*ORDER)
    new = (F.row_number().over(inside) > 1) & _parted(F.col("ts"), F.lag("ts").over(inside), ttl)
    local = turns.withColumn("_new", new.cast("int")).withColumn("_local", F.sum("_new").over(inside).cast("int")).drop("_new")
    state = Window.partitionBy("session_id", "_slice", "_local").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    last = {f: F.last(F.when(filled(f), F.col(f)), ignorenulls=True).over(state) for f in NAMES}
    first = F.first(F.when(filled("channel"), F.struct("channel", "channel_confidence")), ignorenulls=True).over(state)
    return local.withColumns({**last, "_channel": first})


def summaries(states: DataFrame) -> DataFrame:
    """states of _within. One row for each slice: first_ts, last_ts, more (states it starts after its first) and end (its last state)."""
    order = F.struct(*ORDER)
    end = F.struct(*NAMES, "_channel")
    return states.groupBy("session_id", "_slice").agg(F.min_by("ts", order).alias("first_ts"), F.max_by("ts", order).alias("last_ts"), F.max("_local").alias("more"), F.max_by(end, order).alias("end"))


def scan(slices: DataFrame, ttl: float = TTL_SECONDS) -> DataFrame:
    """slices of ``summaries``. session_id, _slice, _epoch (the number of its first state), _left (the fields and channel it takes over)."""
    along = Window.partitionBy("session_id").orderBy("_slice")
    new = _parted(F.col("first_ts"), F.lag("last_ts").over(along), ttl).cast("int")
    # the first state of a slice is new or the last of the slice before
    counted = slices.withColumn("_new", new).withColumn("_to", F.sum(F.col("_new") + F.col("more")).over(along).cast("int"))
    numbered = counted.withColumn("_from", F.col("_to") - F.col("more"))
    # what a slice takes over comes from slices that end in the state it begins with: beginnings and ends in order, by state
    begin = F.struct(F.col("_from").alias("epoch"), F.lit(0).alias("side"), F.lit(None).cast(slices.schema["end"].dataType).alias("end"))
    finish = F.struct(F.col("_to").alias("epoch"), F.lit(1).alias("side"), F.col("end").alias("end"))
    both = numbered.select("session_id", "_slice", F.explode(F.array(begin, finish)).alias("p")).select("session_id", "_slice", "p.*")
    before = Window.partitionBy("session_id", "epoch").orderBy("_slice", "side").rowsBetween(Window.unboundedPreceding, -1)
    left = F.struct(*[F.last(f"end.{f}", ignorenulls=True).over(before).alias(f) for f in NAMES], F.first("end._channel", ignorenulls=True).over(before).alias("_channel"))
    return both.withColumn("_left", left).filter("side = 0").select("session_id", "_slice", F.col("epoch").alias("_epoch"), "_left")


def replay_sliced(turns: DataFrame, ttl: float = TTL_SECONDS, rows: int = SLICE) -> DataFrame:
    """As ``dialogue.replay``, whatever the length of a session. rows: turns of a range, on average."""
    states = durable(_within(_ranges(turns, rows), ttl), "slice-states")
    starts = durable(scan(summaries(states), ttl), "slice-starts")
    joined = states.join(starts, ["session_id", "_slice"])
    begins = F.col("_local") == 0
    values = {f: F.coalesce(f, F.when(begins, F.col(f"_left.{f}"))) for f in NAMES}
    channel = F.coalesce(F.when(begins, F.col("_left._channel")), "_channel")
    whole = joined.withColumns({**values, "_set": channel, "epoch": F.col("_epoch") + F.col("_local")})
    done = whole.withColumns({"channel": F.col("_set.channel"), "channel_confidence": F.col("_set.channel_confidence")})
    return dialogue_status(missing_fields(done.select(*turns.columns, "epoch")))
