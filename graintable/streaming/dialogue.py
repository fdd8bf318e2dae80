"""Dialogue state: batch replay by windows, and the same state machine as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TTL_SECONDS = 600
# fixed values: the fields asked for, in order, with label and question; texts and quick options
FIELDS = (
    ("materialName", "材料名称", "您想查询什么材料的价格？（如：钢筋、水泥、铝合金等）"),
    ("province", "省份", "请问是哪个省份的材料？（如：广东省、江苏省）"),
    ("city", "城市", "具体是哪个城市？（如：深圳市、南京市）"),
    ("materialModelSpec", "规格型号", "请问需要什么规格型号？（如：HRB400、P.O 42.5，不知道可直接跳过）"),
    ("brand", "品牌", "有指定的品牌吗？（如：宝钢、三棵树，没有可直接跳过）"),
)
NAMES = tuple(f for f, _, _ in FIELDS)
QUICK = {"province": ("广东省", "江苏省", "浙江省", "北京市", "上海市"), "city": ("深圳市", "广州市", "南京市", "杭州市")}
CHOICES, CONFIRM = ("🔍 直接查询", "➕ 补充条件"), ("✅ 确认查询", "🔄 修改条件")
CHANNEL_NAMES = {"information_price": "信息价", "manufacturer_price": "厂商报价", "zc_price": "智诚信息价"}
UNKNOWN_CHANNEL, EVERYWHERE, UNSET = "未知渠道", "全国", "未指定"
SET_LINE, UNSET_LINE = "  ✅ {}：", "  ⭕ {}：{}"
RECEIVED, RECEIVED_END, CURRENT_CHANNEL = "收到，查询「", "」的价格。", "\n当前渠道："
OFFER, OFFER_PLACE, OFFER_END = "」在", "的价格。\n\n当前查询条件：\n", "\n您可以选择：\n1. 直接查询（使用当前条件）\n2. 补充更多信息"
COMPLETE, COMPLETE_END = "信息已收集完整！\n查询条件：\n", "\n正在为您查询..."
SURE = 0.8

EPOCH = ["session_id", "epoch"]


def filled(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) != ""


def named_sessions(turns: DataFrame) -> DataFrame:
    """A turn without a session is a session of its own."""
    return turns.withColumn("session_id", F.coalesce(F.col("session_id").cast("string"), F.concat(F.lit("new-"), F.xxhash64("turn", "ts").cast("string"))))


def sessionize(turns: DataFrame, ttl: float = TTL_SECONDS) -> DataFrame:
    """turns: session_id, turn, ts. Adds epoch, the number of the state under its session: a gap longer than ttl starts the next. A turn without a session is a session of its own."""
    named = named_sessions(turns)
    order = Window.partitionBy("session_id").orderBy("ts", "turn")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order))
    new = named.withColumn("_new", F.when(gap.isNull() | (gap > int(ttl * 1_000_000)), 1).otherwise(0))
    return new.withColumn("epoch", F.sum("_new").over(order).cast("int")).drop("_new")


def running() -> Window:
    return Window.partitionBy(*EPOCH).orderBy("ts", "turn").rowsBetween(Window.unboundedPreceding, 0)


def accumulate_entities(turns: DataFrame, fields: tuple[str, ...] = NAMES) -> DataFrame:
    """Each field's last value that isn't empty, up to the turn."""
    last = {f: F.last(F.when(filled(f), F.col(f)), ignorenulls=True).over(running()) for f in fields}
    return turns.withColumns(last)


def sticky_channel(turns: DataFrame) -> DataFrame:
    """Channel and confidence of the first turn that sets a channel."""
    first = F.first(F.when(filled("channel"), F.struct("channel", "channel_confidence")), ignorenulls=True).over(running())
    return turns.withColumn("_first", first).withColumn("channel", F.col("_first.channel")).withColumn("channel_confidence", F.col("_first.channel_confidence")).drop("_first")


def missing_fields(turns: DataFrame) -> DataFrame:
    """Adds missing (fields without a value, in order) and the next question: next_field, next_label, next_prompt."""
    rows = F.array(*[F.when(~filled(f), F.struct(F.lit(f).alias("field"), F.lit(label).alias("label"), F.lit(prompt).alias("prompt"))) for f, label, prompt in FIELDS])
    open_rows = turns.withColumn("_open", F.filter(rows, lambda r: r.isNotNull()))
    first = F.get("_open", F.lit(0))
    return open_rows.select(*turns.columns, F.transform("_open", lambda r: r["field"]).alias("missing"), first["field"].alias("next_field"), first["label"].alias("next_label"), first["prompt"].alias("next_prompt"))


def dialogue_status(turns: DataFrame) -> DataFrame:
    """turns with missing. Adds status, is_complete, can_query and completed (a query runs by itself once nothing is missing)."""
    named = filled("materialName")
    ready = named & (F.size("missing") == 0)
    return turns.withColumns({"status": F.when(ready, "ready").otherwise("collecting"), "is_complete": named, "can_query": named, "completed": ready})


def replay(turns: DataFrame, ttl: float = TTL_SECONDS) -> DataFrame:
    """The state after every turn. One shuffle by session serves all windows."""
    return dialogue_status(missing_fields(sticky_channel(accumulate_entities(sessionize(turns, ttl)))))


def dialogue_response(states: DataFrame) -> DataFrame:
    """states of ``replay``. Adds response_text and quick_options."""
    value = lambda c, other: F.coalesce(F.col(c), F.lit(other))
    lines = F.concat_ws("\n", *[F.when(filled(f), F.concat(F.lit(SET_LINE.format(label)), F.col(f))).otherwise(UNSET_LINE.format(label, UNSET)) for f, label, _ in FIELDS])
    channel = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in CHANNEL_NAMES.items() for x in p]), F.coalesce("channel", F.lit(""))), F.lit(UNKNOWN_CHANNEL))
    unsure = F.coalesce("channel_confidence", F.lit(0.0)) < SURE
    ask = F.concat(F.lit(RECEIVED), F.col("materialName"), F.lit(RECEIVED_END + CURRENT_CHANNEL), channel, F.lit("\n"), F.col("next_prompt"))
    offer = F.concat(F.lit(RECEIVED), F.col("materialName"), F.lit(OFFER), value("province", EVERYWHERE), value("city", ""), F.lit(OFFER_PLACE), lines, F.lit(OFFER_END))
    done = F.concat(F.lit(COMPLETE), lines, F.lit(COMPLETE_END))
    options = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")
    by_field = F.when(F.col("next_field") == "province", options(QUICK["province"])).when(F.col("next_field") == "city", options(QUICK["city"])).otherwise(options(()))
    text = F.when(~F.col("is_complete"), F.col("next_prompt")).when(F.col("status") == "ready", done).when(unsure, ask).otherwise(offer)
    quick = F.when(~F.col("is_complete"), by_field).when(F.col("status") == "ready", options(CONFIRM)).when(unsure, options(())).otherwise(options(CHOICES))
    return states.withColumns({"response_text": text, "quick_options": quick})


def session_summary(states: DataFrame, now: Column, ttl: float = TTL_SECONDS) -> DataFrame:
    """Of each session's last state: status, entities, missing, history_count (two messages a turn), last_updated and expires_in seconds."""
    last = states.groupBy(*EPOCH).agg(F.max_by(F.struct("status", *NAMES, "missing", "ts"), F.struct("ts", "turn")).alias("s"), F.count(F.lit(1)).alias("n"))
    newest = last.groupBy("session_id").agg(F.max_by(F.struct("epoch", "s", "n"), "epoch").alias("x"))
    left = ttl - (F.unix_micros(now) - F.unix_micros("x.s.ts")) / 1_000_000
    return newest.select("session_id", "x.epoch", "x.s.status", *[F.col(f"x.s.{f}") for f in NAMES], "x.s.missing", (F.col("x.n") * 2).alias("history_count"), F.col("x.s.ts").alias("last_updated"), left.alias("expires_in"))


def expire_sessions(turns: DataFrame, now: Column, ttl: float = TTL_SECONDS, cleared: DataFrame | None = None) -> DataFrame:
    """session_id, last_updated and expired: idle for longer than ttl, or cleared by request (cleared: session_id)."""
    last = turns.groupBy("session_id").agg(F.max("ts").alias("last_updated"))
    idle = F.unix_micros(now) - F.unix_micros("last_updated") > int(ttl * 1_000_000)
    if cleared is None:
        return last.withColumn("expired", idle)
    return last.join(cleared.select("session_id", F.lit(True).alias("_c")).distinct(), "session_id", "left").select("session_id", "last_updated", (idle | F.coalesce("_c", F.lit(False))).alias("expired"))


def trim_history(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """What is left of each conversation when its messages come in pairs and more than ten are cut to the last six."""
    # counted by pairs, not gathered: k exchanges leave 2k messages up to k = 5, then 6, 8, 10, 6, ...
    counts = messages.groupBy(conversation).agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.ceil(F.col("_n") / 2))
    kept = F.when(F.col("_k") <= 5, F.col("_k") * 2).otherwise(6 + (F.col("_k") - 6) % 3 * 2) - F.col("_n") % 2
    place = F.row_number().over(Window.partitionBy(conversation).orderBy(F.col(turn).desc()))
    return messages.withColumn("_place", place).join(counts.select(conversation, kept.alias("_kept")), conversation).filter("_place <= _kept").drop("_place", "_kept")


def request_metrics(requests: DataFrame, width: str = "1 hour") -> DataFrame:
    """requests: ts, kind, output_tokens, ttft_s, total_s. Per kind and window: requests, mean time, tokens a second (null where no time passed), p50 and p95 of the time."""
    rate = F.col("output_tokens") / F.nullif(F.col("total_s"), F.lit(0.0))
    return (
        requests.withColumn("_rate", rate).groupBy("kind", F.window("ts", width).alias("w"))
        .agg(F.count(F.lit(1)).alias("requests"), F.avg("ttft_s").alias("mean_ttft_s"), F.avg("total_s").alias("mean_total_s"), F.avg("_rate").alias("tokens_per_s"),
             F.percentile("total_s", F.lit(0.5)).alias("p50_total_s"), F.percentile("total_s", F.lit(0.95)).alias("p95_total_s"))
        .select("kind", F.col("w.start").alias("window_start"), "requests", "mean_ttft_s", "mean_total_s", "tokens_per_s", "p50_total_s", "p95_total_s")
    )


def request_metrics_stream(requests: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The same on a stream; percentiles are approximate there."""
    rate = F.col("output_tokens") / F.nullif(F.col("total_s"), F.lit(0.0))
    return (
        requests.withWatermark("ts", late).withColumn("_rate", rate).groupBy("kind", F.window("ts", width).alias("w"))
        .agg(F.count(F.lit(1)).alias("requests"), F.avg("total_s").alias("mean_total_s"), F.avg("_rate").alias("tokens_per_s"), F.percentile_approx("total_s", [0.5, 0.95]).alias("p"))
        .select("kind", F.col("w.start").alias("window_start"), "requests", "mean_total_s", "tokens_per_s", F.col("p")[0].alias("p50_total_s"), F.col("p")[1].alias("p95_total_s"))
    )


_TEXTS = ", ".join(f"{f} string" for f in NAMES)
STREAM_SCHEMA = f"session_id string, turn int, ts timestamp, epoch int, {_TEXTS}, channel string, channel_confidence double, missing array<string>, status string, is_complete boolean"
STATE_SCHEMA = f"epoch int, last_us long, {_TEXTS}, channel string, channel_confidence double"


def stream_dialogue(turns: DataFrame, ttl: float = TTL_SECONDS, late: str = "1 hour") -> DataFrame:
    """turns (a stream): session_id, turn, ts, the entity fields, channel, channel_confidence. The state after every turn, as ``replay`` gives it.

    State is kept by session and dropped once the watermark is ttl past its last turn; turns later than the watermark are dropped by
    Spark before they get here. A state that comes back after it was dropped starts at epoch 1 again.
    """
    ttl_us = int(ttl * 1_000_000)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        epoch, last, *values = state.get if state.exists else (0, None, *[None] * (len(NAMES) + 2))
        entities, (channel, confidence) = dict(zip(NAMES, values, strict=False)), values[len(NAMES) :]
        out = []
        turns = pd.concat(list(parts)).sort_values(["ts", "turn"])
        for row in turns.to_dict("records"):
            now = int(row["ts"].value // 1000)
            if last is None or now - last > ttl_us:
                epoch, entities, channel, confidence = epoch + 1, dict.fromkeys(NAMES), None, None
            last = now if last is None else max(last, now)
            for f in NAMES:
                if isinstance(row[f], str) and row[f]:
                    entities[f] = row[f]
            if channel is None and isinstance(row["channel"], str) and row["channel"]:
                channel, confidence = row["channel"], None if pd.isna(row["channel_confidence"]) else float(row["channel_confidence"])
            missing = [f for f in NAMES if not entities[f]]
            out.append({"session_id": key[0], "turn": row["turn"], "ts": row["ts"], "epoch": epoch, **entities, "channel": channel, "channel_confidence": confidence, "missing": missing, "status": "collecting" if missing else "ready", "is_complete": bool(entities["materialName"])})
        state.update((epoch, last, *[entities[f] for f in NAMES], channel, confidence))
        deadline = max(last // 1000 + int(ttl * 1000), state.getCurrentWatermarkMs() + 1)
        state.setTimeoutTimestamp(deadline)
        yield pd.DataFrame(out)

    needed = turns.select("session_id", "turn", "ts", *NAMES, "channel", "channel_confidence").withWatermark("ts", late)
    return needed.groupBy("session_id").applyInPandasWithState(step, STREAM_SCHEMA, STATE_SCHEMA, "append", "EventTimeTimeout")
