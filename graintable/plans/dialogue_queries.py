"""Queries over turns, conversations and requests, with the same in SQL for DuckDB.

Events stand for turns (a user's events are a session; sessions here may pause for half a day) and for requests, documents for questions
and model outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import routing
from ..streaming import dialogue, slices

QUERIES = {}
ORACLES = {}
TTL = 43_200  # seconds; events of a user are hours apart
NOW = "TIMESTAMP '2024-02-15 00:00:00'"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- turns ----------------------------------------------------------------------------------------------------------------------

FIELD_OF = {"materialName": "view", "province": "signup", "city": "click", "materialModelSpec": "purchase", "brand": "error"}


def turns(spark: SparkSession, d: str) -> DataFrame:
    return turns_of(spark.read.parquet(f"{d}/events.parquet"))


def turns_of(e: DataFrame) -> DataFrame:
    """Each event gives the field of its type a value (sometimes an empty one), every seventh a channel."""
    text = F.when(F.col("event_id") % 6 == 0, "").otherwise(F.concat(F.lit("v"), F.col("event_id") % 10))
    fields = [F.when(F.col("event_type") == kind, text).alias(f) for f, kind in FIELD_OF.items()]
    channel = F.when(F.col("event_id") % 7 == 0, "zc_price").when(F.col("event_id") % 7 == 1, "")
    return e.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").cast("int").alias("turn"), F.col("ts").cast("timestamp").alias("ts"), *fields, channel.alias("channel"), F.when(channel == "zc_price", F.lit(0.6)).alias("channel_confidence"))


TURNS_SQL = (
    "turns AS (SELECT user_id::VARCHAR AS session_id, event_id::INTEGER AS turn, ts, "
    + ", ".join(f"CASE WHEN event_type = '{kind}' THEN CASE WHEN event_id % 6 = 0 THEN '' ELSE 'v' || event_id % 10 END END AS {f}" for f, kind in FIELD_OF.items())
    + ", CASE WHEN event_id % 7 = 0 THEN 'zc_price' WHEN event_id % 7 = 1 THEN '' END AS channel, CASE WHEN event_id % 7 = 0 THEN 0.6::DOUBLE END AS channel_confidence FROM events),\n"
    f"gaps AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY session_id ORDER BY ts, turn)) <= {TTL}000000 THEN 0 ELSE 1 END AS new FROM turns),\n"
    "sessions AS (SELECT * EXCLUDE (new), (sum(new) OVER (PARTITION BY session_id ORDER BY ts, turn))::INTEGER AS epoch FROM gaps),\n"
    "filled AS (SELECT session_id, turn, ts, epoch, " + ", ".join(f"last_value(nullif({f}, '') IGNORE NULLS) OVER w AS {f}" for f in FIELD_OF)
    + ", first_value(nullif(channel, '') IGNORE NULLS) OVER w AS channel, first_value(CASE WHEN channel <> '' THEN channel_confidence END IGNORE NULLS) OVER w AS channel_confidence"
    " FROM sessions WINDOW w AS (PARTITION BY session_id, epoch ORDER BY ts, turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),\n"
    "open_fields AS (SELECT *, list_filter([" + ", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in FIELD_OF) + "], lambda x: x IS NOT NULL) AS missing FROM filled),\n"
    "states AS (SELECT *, CASE WHEN materialName IS NOT NULL AND len(missing) = 0 THEN 'ready' ELSE 'collecting' END AS status, materialName IS NOT NULL AS is_complete FROM open_fields)"
)


def _states(spark: SparkSession, d: str) -> DataFrame:
    return dialogue.replay(turns(spark, d), TTL)


@query(f"WITH {TURNS_SQL} SELECT session_id, turn, epoch FROM sessions")
def sessionize(spark, d):
    return dialogue.sessionize(turns(spark, d), TTL).select("session_id", "turn", "epoch")


@query(f"WITH {TURNS_SQL} SELECT session_id, turn, epoch, {', '.join(FIELD_OF)} FROM filled")
def accumulate_entities(spark, d):
    return dialogue.accumulate_entities(dialogue.sessionize(turns(spark, d), TTL)).select("session_id", "turn", "epoch", *FIELD_OF)


@query(f"WITH {TURNS_SQL} SELECT session_id, turn, channel, channel_confidence FROM filled")
def sticky_channel(spark, d):
    return dialogue.sticky_channel(dialogue.sessionize(turns(spark, d), TTL)).select("session_id", "turn", "channel", "channel_confidence")


@query(f"WITH {TURNS_SQL} SELECT session_id, turn, array_to_string(missing, ',') AS missing, missing[1] AS next_field FROM states")
def missing_fields(spark, d):
    return _states(spark, d).select("session_id", "turn", F.array_join("missing", ",").alias("missing"), "next_field")


@query(f"WITH {TURNS_SQL} SELECT session_id, turn, status, is_complete, is_complete AS can_query, status = 'ready' AS completed FROM states")
def dialogue_status(spark, d):
    return _states(spark, d).select("session_id", "turn", "status", "is_complete", "can_query", "completed")


_LINES_SQL = "concat_ws(chr(10), " + ", ".join(f"CASE WHEN {f} IS NOT NULL THEN '  ✅ {label}：' || {f} ELSE '  ⭕ {label}：{dialogue.UNSET}' END" for f, label, _ in dialogue.FIELDS) + ")"
_PROMPT_SQL = "CASE missing[1] " + " ".join(f"WHEN '{f}' THEN '{prompt}'" for f, _, prompt in dialogue.FIELDS) + " END"
_CHANNEL_SQL = "CASE coalesce(channel, '') " + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in dialogue.CHANNEL_NAMES.items()) + f" ELSE '{dialogue.UNKNOWN_CHANNEL}' END"


@query(
    f"""WITH {TURNS_SQL}, kinds AS (SELECT *, CASE WHEN NOT is_complete THEN 'ask field' WHEN status = 'ready' THEN 'done' WHEN coalesce(channel_confidence, 0) < {dialogue.SURE} THEN 'ask channel' ELSE 'offer' END AS kind FROM states)
SELECT session_id, turn, CASE kind WHEN 'ask field' THEN {_PROMPT_SQL} WHEN 'done' THEN '信息已收集完整！' || chr(10) || '查询条件：' || chr(10) || {_LINES_SQL} || chr(10) || '正在为您查询...'
    WHEN 'ask channel' THEN '收到，查询「' || materialName || '」的价格。' || chr(10) || '当前渠道：' || {_CHANNEL_SQL} || chr(10) || {_PROMPT_SQL}
    ELSE '收到，查询「' || materialName || '」在' || coalesce(province, '{dialogue.EVERYWHERE}') || coalesce(city, '') || '的价格。' || chr(10) || chr(10) || '当前查询条件：' || chr(10) || {_LINES_SQL} || chr(10) || '您可以选择：' || chr(10) || '1. 直接查询（使用当前条件）' || chr(10) || '2. 补充更多信息' END AS response_text,
  CASE kind WHEN 'done' THEN '{"|".join(dialogue.CONFIRM)}' WHEN 'offer' THEN '{"|".join(dialogue.CHOICES)}' WHEN 'ask field' THEN CASE missing[1] WHEN 'province' THEN '{"|".join(dialogue.QUICK["province"])}' WHEN 'city' THEN '{"|".join(dialogue.QUICK["city"])}' ELSE '' END ELSE '' END AS quick_options FROM kinds"""
)
def dialogue_response(spark, d):
    return dialogue.dialogue_response(_states(spark, d)).select("session_id", "turn", "response_text", F.array_join("quick_options", "|").alias("quick_options"))


@query(
    f"""WITH {TURNS_SQL}, ends AS (SELECT *, count(*) OVER (PARTITION BY session_id, epoch) * 2 AS history_count, row_number() OVER (PARTITION BY session_id ORDER BY epoch DESC, ts DESC, turn DESC) AS i FROM states)
SELECT session_id, epoch, status, {', '.join(FIELD_OF)}, array_to_string(missing, ',') AS missing, history_count, {TTL} - (epoch_us({NOW}) - epoch_us(ts)) / 1000000 AS expires_in FROM ends WHERE i = 1"""
)
def session_summary(spark, d):
    out = dialogue.session_summary(_states(spark, d), F.expr(NOW), TTL)
    return out.drop("last_updated").withColumn("missing", F.array_join("missing", ","))


@query(f"WITH {TURNS_SQL} SELECT session_id, epoch_us(max(ts)) AS last_updated_us, epoch_us({NOW}) - epoch_us(max(ts)) > {TTL}000000 OR session_id::BIGINT % 50 = 0 AS expired FROM turns GROUP BY 1")
def expire_sessions(spark, d):
    """Idle sessions, and those of every fiftieth user, cleared by request."""
    t = turns(spark, d)
    out = dialogue.expire_sessions(t, F.expr(NOW), TTL, t.filter(F.col("session_id").cast("long") % 50 == 0))
    return out.select("session_id", F.unix_micros("last_updated").alias("last_updated_us"), "expired")


@query(
    """WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role <> 'system'), k AS (SELECT *, (n + 1) // 2 AS k FROM m)
SELECT conv_id, turn, role FROM k WHERE place <= CASE WHEN k <= 5 THEN 2 * k ELSE 6 + (k - 6) % 3 * 2 END - n % 2"""
)
def trim_history(spark, d):
    messages = spark.read.parquet(f"{d}/conversations.parquet").filter("role <> 'system'")
    return dialogue.trim_history(messages).select("conv_id", "turn", "role")


@query(
    """SELECT event_type AS kind, date_trunc('day', ts) AS window_start, count(*) AS requests, round(avg(value / 10), 7) AS mean_ttft_s, round(avg(value), 7) AS mean_total_s, round(avg((event_id % 500) / nullif(value, 0)), 7) AS tokens_per_s,
  round(quantile_cont(value, 0.5), 7) AS p50_total_s, round(quantile_cont(value, 0.95), 7) AS p95_total_s FROM events GROUP BY 1, 2"""
)
def request_metrics(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    requests = e.select("ts", F.col("event_type").alias("kind"), (F.col("event_id") % 500).alias("output_tokens"), (F.col("value") / 10).alias("ttft_s"), F.col("value").alias("total_s"))
    out = dialogue.request_metrics(requests, "1 day")
    return out.withColumns({c: F.round(c, 7) for c in ("mean_ttft_s", "mean_total_s", "tokens_per_s", "p50_total_s", "p95_total_s")})


@query(f"WITH {TURNS_SQL} SELECT session_id, turn, epoch, {', '.join(FIELD_OF)}, channel, channel_confidence, array_to_string(missing, ',') AS missing, status, is_complete FROM states")
def stream_dialogue(spark, d):
    """All turns through the streaming job, read as a stream of the events' file: the state after each, as the replay has it."""
    import uuid

    from ..durable import shared_dir

    schema = spark.read.parquet(f"{d}/events.parquet").schema
    # a stream reads a folder: that of the tables, and there the events alone
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(d)
    out = f"{shared_dir(spark)}/dialogue-{uuid.uuid4().hex}"
    states = dialogue.stream_dialogue(turns_of(events), TTL, late="1 hour")
    states.writeStream.format("parquet").option("path", f"{out}/states").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/states").drop("ts").withColumn("missing", F.array_join("missing", ","))


@query(f"WITH {TURNS_SQL} SELECT session_id, turn, epoch, {', '.join(FIELD_OF)}, channel, channel_confidence, array_to_string(missing, ',') AS missing, status, is_complete FROM states")
def replay_sliced(spark, d):
    """The state after every turn, sessions cut into slices."""
    states = slices.replay_sliced(turns(spark, d), TTL)
    return states.select("session_id", "turn", "epoch", *FIELD_OF, "channel", "channel_confidence", F.array_join("missing", ",").alias("missing"), "status", "is_complete")


@query()
def dialogue_answers(spark, d):
    """Turns through the streaming job to price answers. Each user asks for what their order's first line is of: an event names the field of its type.

    The stored turns arrive in four parts, in order of time, so that timers fire and dialogues become ready in different micro-batches.
    """
    import uuid

    from ..durable import durable, shared_dir
    from ..sources.files import read_turns_stream
    from ..sources.prices import price_records
    from ..streaming import sessions

    records = durable(price_records(spark, d), "records")
    said = durable(turns_asked(spark, d, records), "turns")
    folder = f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}"
    files = store_turns(said, f"{folder}/in")
    stream = read_turns_stream(spark, f"{folder}/in", said.schema, files)
    sessions.answer_dialogues(stream, records, f"{folder}/out", TTL).awaitTermination()
    return sessions.read_answers(spark, f"{folder}/out").drop("batch")


def store_turns(said: DataFrame, folder: str, parts: int = 4, turns_a_file: int = 50_000) -> int:
    """Turns as JSON in parts of equal spans of time, one after the other. Gives the number of files, the same for each part, so that as many a trigger are one part."""
    first, last = said.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    at = F.floor((F.unix_micros("ts") - first) * parts / (last - first + 1)) if first is not None else F.lit(0)
    sizes = {r["part"]: r["count"] for r in said.groupBy(at.alias("part")).count().collect()}
    # some task has a row for each file, so none is left out as empty
    files = max(1, min(sizes.get(part, 0) for part in range(parts)) // turns_a_file)
    for part in range(parts):
        rows = said.filter(at == part)
        (rows.repartition(files) if files > 1 else rows.coalesce(1)).write.mode("append").json(folder)
    return files


def turns_asked(spark: SparkSession, d: str, records: DataFrame) -> DataFrame:
    """Turns of the events, whose values are those of the user's own record; users without one have no turns."""
    own = records.select(F.col("record_id").alias("_own"), *[F.col(f).alias(f"_{f}") for f in FIELD_OF], F.col("channel").alias("_channel"))
    said = turns(spark, d).withColumn("_own", F.concat("session_id", F.lit("-1"))).join(own, "_own")
    fields = {f: F.when(F.col(f) != "", F.col(f"_{f}")) for f in FIELD_OF}
    return said.withColumns({**fields, "channel": F.when(F.col("channel") != "", F.col("_channel"))}).select("session_id", "turn", "ts", *FIELD_OF, "channel", "channel_confidence")


# --- questions ------------------------------------------------------------------------------------------------------------------

_WORDS = sorted(w for words in routing.KEYWORDS.values() for w in words)
QUESTION = "CASE WHEN doc_id % 4 = 0 THEN {word1} WHEN doc_id % 4 = 1 THEN {word1} || {word2} WHEN doc_id % 4 = 2 THEN 'gb ' || {word2} ELSE '' END || coalesce(text, '')"
ENTITIES = {"brand": "CASE WHEN doc_id % 5 = 0 THEN 'b' ELSE '' END", "materialModelSpec": "CASE WHEN doc_id % 3 = 0 THEN 's' END", "materialName": "CASE WHEN doc_id % 2 = 0 THEN 'm' END",
            "startReleaseDate": "CASE WHEN doc_id % 7 = 0 THEN '2024-01-01' END", "endReleaseDate": "CASE WHEN doc_id % 11 = 0 THEN '2024-12-31' ELSE '' END"}


def _question(pick) -> str:
    return QUESTION.format(word1=pick("doc_id * 7"), word2=pick("doc_id * 3 + 1"))


_LIST = ", ".join(f"'{w}'" for w in _WORDS)
QUESTIONS_SQL = f"questions AS (SELECT doc_id AS question_id, {_question(lambda k: f'[{_LIST}][({k}) % {len(_WORDS)} + 1]')} AS question, {', '.join(f'{sql} AS {n}' for n, sql in ENTITIES.items())} FROM documents)"
KEYWORDS_SQL = "keywords AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{w}', {x}::DOUBLE, {i})" for c, words in routing.KEYWORDS.items() for i, (w, x) in enumerate(words.items())) + ") k(channel, keyword, weight, ord))"
NAMED_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(lower(question), '{w}')''' for w in words)} THEN '{c}'" for c, words in routing.NAMED.items()) + " END"
SCORES_SQL = f"""{QUESTIONS_SQL}, {KEYWORDS_SQL}, scores AS (SELECT question_id, channel, round(sum(weight), 6) AS score, array_to_string(list(keyword ORDER BY ord), ',') AS matched FROM questions JOIN keywords ON contains(lower(question), lower(keyword)) GROUP BY ALL),
flags AS (SELECT question_id, coalesce(brand, '') <> '' AS b, coalesce(materialModelSpec, '') <> '' AND coalesce(materialName, '') <> '' AS s, coalesce(startReleaseDate, '') <> '' OR coalesce(endReleaseDate, '') <> '' AS t FROM questions),
bonuses AS (SELECT question_id, 'manufacturer_price' AS channel, 0.5::DOUBLE AS bonus, b FROM flags WHERE b UNION ALL SELECT question_id, 'information_price', CASE WHEN t THEN 0.1 ELSE 0.2 END::DOUBLE, b FROM flags WHERE t OR s UNION ALL SELECT question_id, 'zc_price', 0.15::DOUBLE, b FROM flags WHERE t),
totals AS (SELECT coalesce(s.question_id, o.question_id) AS question_id, coalesce(s.channel, o.channel) AS channel, round(coalesce(score, 0) + coalesce(bonus, 0), 6) AS score, concat_ws(',', matched, CASE WHEN b THEN '[实体特征]检测到品牌信息' END) AS matched FROM scores s FULL JOIN bonuses o ON s.question_id = o.question_id AND s.channel = o.channel),
best AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, CASE channel WHEN 'zc_price' THEN 1 WHEN 'manufacturer_price' THEN 2 ELSE 3 END) AS i FROM totals),
inferred AS (SELECT q.question_id, CASE WHEN named IS NOT NULL THEN named WHEN score > 0.3 THEN b.channel WHEN materialName <> '' THEN 'information_price' ELSE 'unknown' END AS channel,
  CASE WHEN named IS NOT NULL THEN 1.0 WHEN score > 0.3 THEN least(score / 1.5, 0.95) WHEN materialName <> '' THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence,
  CASE WHEN named IS NOT NULL THEN CASE named WHEN 'information_price' THEN '信息价' WHEN 'manufacturer_price' THEN '厂商报价' ELSE '智诚' END WHEN score > 0.3 THEN matched ELSE '' END AS matched_keywords,
  CASE WHEN named IS NOT NULL THEN '根据关键词「' || CASE named WHEN 'information_price' THEN '信息价' WHEN 'manufacturer_price' THEN '厂商报价' ELSE '智诚' END || '」明确识别'
    WHEN score > 0.3 THEN '根据关键词「' || array_to_string(list_slice(string_split(matched, ','), 1, 3), ', ') || '」推断' WHEN materialName <> '' THEN '未明确指定渠道，默认查询信息价（政府指导价）' ELSE '无法识别查询渠道' END AS reason,
  named IS NULL AND coalesce(score, 0) <= 0.3 AS unsure, materialName
  FROM (SELECT *, {NAMED_SQL} AS named FROM questions) q LEFT JOIN (SELECT * FROM best WHERE i = 1) b ON q.question_id = b.question_id)"""


def questions(spark: SparkSession, d: str) -> DataFrame:
    listed = "array(" + _LIST + ")"
    sql = _question(lambda k: f"{listed}[int(({k}) % {len(_WORDS)})]")
    return spark.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id AS question_id", f"{sql} AS question", *[f"{x} AS {n}" for n, x in ENTITIES.items()])


@query(f"WITH {QUESTIONS_SQL} SELECT question_id, {NAMED_SQL} AS channel FROM questions")
def channel_exact_match(spark, d):
    return questions(spark, d).select("question_id", routing.exact_channel(F.col("question")).alias("channel"))


@query(f"WITH {SCORES_SQL} SELECT * FROM scores")
def channel_keyword_score(spark, d):
    return routing.keyword_scores(questions(spark, d), routing.keyword_table(spark)).withColumn("matched", F.array_join("matched", ","))


@query(f"WITH {SCORES_SQL} SELECT question_id, channel, bonus, CASE WHEN b THEN '{routing.BRAND_REASON}' END AS reason FROM bonuses")
def channel_entity_bonus(spark, d):
    return routing.entity_bonus(questions(spark, d))


def _inferred(spark: SparkSession, d: str) -> DataFrame:
    return routing.infer_channel(questions(spark, d), routing.keyword_table(spark))


@query(f"WITH {SCORES_SQL} SELECT question_id, channel, round(confidence, 6) AS confidence, reason, matched_keywords FROM inferred")
def infer_channel(spark, d):
    return _inferred(spark, d).select("question_id", "channel", F.round("confidence", 6).alias("confidence"), "reason", F.array_join("matched_keywords", ",").alias("matched_keywords"))


NAME_SQL = "CASE channel " + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in routing.DISPLAY.items()) + " END"


@query(
    f"""WITH {SCORES_SQL}, told AS (SELECT *, CASE WHEN unsure THEN CASE WHEN materialName <> '' THEN '{routing.DEFAULT_SUGGESTION}' ELSE '{routing.UNKNOWN_SUGGESTION}' END END AS suggestion FROM inferred)
SELECT question_id, channel, round(confidence, 6) AS confidence, CASE WHEN confidence >= 1 THEN '{routing.KNOWN}' || {NAME_SQL} WHEN confidence >= 0.7 THEN '{routing.INFERRED}' || {NAME_SQL} || '（' || reason || '）'
  WHEN confidence > 0 THEN '{routing.DEFAULTED}' || {NAME_SQL} || '，' || coalesce(suggestion, '') ELSE coalesce(suggestion, '{routing.ASK_CHANNEL}') END AS suggestion_text, confidence < 0.7 AND channel <> 'unknown' AS should_confirm FROM told"""
)
def channel_suggestion(spark, d):
    return routing.channel_suggestion(_inferred(spark, d)).withColumn("confidence", F.round("confidence", 6))


# --- model outputs --------------------------------------------------------------------------------------------------------------

LABELS = ["price_recommendation", "knowledge_qa", "other", "dangerous_sql"]
OUTPUT = "CASE doc_id % 8 WHEN 0 THEN 'price_recommendation' WHEN 1 THEN '  knowledge_qa ' WHEN 2 THEN 'I think: dangerous_sql.' WHEN 3 THEN 'PRICE-RECOMMENDATION' WHEN 4 THEN '' WHEN 5 THEN 'Other' WHEN 6 THEN 'knowledge' ELSE text END"
_P = "replace(replace(lower({}), '_', ''), '-', '')"
LABEL_SQL = f"""outputs AS (SELECT doc_id, {OUTPUT} AS raw, trim({OUTPUT}) AS o FROM documents),
labelled AS (SELECT doc_id, CASE WHEN o = '' THEN 'other' WHEN o IN ('price_recommendation', 'knowledge_qa', 'other', 'dangerous_sql') THEN o ELSE coalesce(list_filter({LABELS}, lambda a: contains(o, a))[1],
  CASE WHEN {_P.format('o')} <> '' THEN list_filter({LABELS}, lambda a: contains({_P.format('o')}, {_P.format('a')}) OR contains({_P.format('a')}, {_P.format('o')}))[1] END, 'other') END AS label FROM outputs)"""


@query(f"WITH {LABEL_SQL} SELECT doc_id, label FROM labelled")
def normalize_label(spark, d):
    outputs = spark.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id", f"{OUTPUT} AS raw")
    return outputs.select("doc_id", routing.normalize_label(F.col("raw"), LABELS, "other").alias("label"))


@query(f"WITH {LABEL_SQL} SELECT doc_id, CASE WHEN label IN ('price_recommendation', 'knowledge_qa', 'dangerous_sql') THEN label ELSE 'price_recommendation' END AS workflow FROM labelled")
def route_intent(spark, d):
    outputs = spark.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id", f"{OUTPUT} AS raw")
    return outputs.select("doc_id", routing.route_intent(routing.normalize_label(F.col("raw"), LABELS, "other")).alias("workflow"))


def _json_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Answers with the source and language of each document, fenced, bare, commented, cut short or empty."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    body = F.concat(F.lit('{"materialName": "'), "source", F.lit('", "province": "'), "lang", F.lit('", "city": null}'))
    k = F.col("doc_id") % 6
    text = (
        F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 1, F.concat(F.lit("json\n"), body)).when(k == 2, F.concat(F.lit("```\n// a note\n"), body, F.lit("\n```")))
        .when(k == 3, F.substring(body, F.lit(1), F.length(body) - 20)).when(k == 4, "").otherwise(body)
    )
    return docs.select("doc_id", text.alias("text"))


@query("SELECT doc_id, CASE WHEN doc_id % 6 NOT IN (3, 4) THEN source END AS materialName, CASE WHEN doc_id % 6 NOT IN (3, 4) THEN lang END AS province, CASE WHEN doc_id % 6 IN (3, 4) THEN 0 ELSE 3 END AS n FROM documents")
def parse_fenced_json(spark, d):
    m = routing.parse_fenced_json(F.col("text"))
    return _json_outputs(spark, d).select("doc_id", m["materialName"].alias("materialName"), m["province"].alias("province"), F.size(m).alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 6 <> 4 THEN source END AS materialName, CASE WHEN doc_id % 6 = 3 THEN '' WHEN doc_id % 6 <> 4 THEN lang END AS province, CASE doc_id % 6 WHEN 4 THEN 0 WHEN 3 THEN 2 ELSE 3 END AS n FROM documents")
def lenient_kv_parse(spark, d):
    """As above; answers cut short end behind the second field's colon."""
    m = routing.lenient_kv_parse(routing.unfenced(F.col("text")))
    return _json_outputs(spark, d).select("doc_id", m["materialName"].alias("materialName"), m["province"].alias("province"), F.size(m).alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 6 NOT IN (3, 4) THEN source WHEN doc_id % 2 = 0 THEN 'base' END AS materialName, CASE WHEN doc_id % 6 NOT IN (3, 4) THEN lang END AS province, 'kept' AS other FROM documents")
def merge_entities(spark, d):
    base = F.create_map(F.lit("materialName"), F.when(F.col("doc_id") % 2 == 0, "base").otherwise(""), F.lit("other"), F.lit("kept"))
    m = routing.merge_entities(base, routing.parse_fenced_json(F.col("text")), ["materialName", "province", "city"])
    return _json_outputs(spark, d).select("doc_id", m["materialName"].alias("materialName"), m["province"].alias("province"), m["other"].alias("other"))
