"""Routing of questions and reading of model outputs, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: keywords of the channels with their weights, words that name a channel outright, and texts
KEYWORDS = {
    "information_price": {
        "信息价": 1.0, "政府指导价": 1.0, "造价站": 1.0, "官方价格": 0.9, "定额": 0.9, "清单计价": 0.9,
        "指导价": 0.7, "基准价": 0.7, "信息价库": 0.7, "GBT": 0.6, "GB": 0.6, "规范": 0.6, "标准": 0.6,
        "参考价": 0.4, "市场价走势": 0.4,
    },
    "manufacturer_price": {
        "厂商报价": 1.0, "厂家报价": 1.0, "品牌报价": 1.0, "供应商": 0.9, "经销商": 0.9, "厂家直供": 0.9,
        "询价": 0.7, "报价单": 0.7, "品牌": 0.6, "三棵树": 0.8, "宝钢": 0.8, "鞍钢": 0.8, "立邦": 0.8,
        "海螺": 0.8, "南方水泥": 0.8, "金隅": 0.8, "零售价": 0.4, "批发价": 0.4,
    },
    "zc_price": {
        "智诚": 1.0, "智诚信息价": 1.0, "第三方价格": 0.9, "实际成交价": 0.7, "市场行情": 0.7, "行情价": 0.7,
        "市场价": 0.6, "市场均价": 0.6, "行情": 0.4, "走势": 0.4,
    },
}
NAMED = {"information_price": ("信息价", "造价站", "政府指导价"), "manufacturer_price": ("厂商报价", "厂家报价", "品牌报价"), "zc_price": ("智诚",)}
TIE_ORDER = ("zc_price", "manufacturer_price", "information_price")
DISPLAY = {"information_price": "信息价", "manufacturer_price": "厂商报价", "zc_price": "智诚信息价", "unknown": "未知渠道"}
BRAND_REASON, ENTITY_MARK = "检测到品牌信息", "[实体特征]"
REASON, NAMED_END, INFERRED_END = "根据关键词「", "」明确识别", "」推断"
DEFAULT_REASON, DEFAULT_SUGGESTION = "未明确指定渠道，默认查询信息价（政府指导价）", "如需查询厂商报价或智诚信息价，请明确说明"
UNKNOWN_REASON, UNKNOWN_SUGGESTION = "无法识别查询渠道", "请明确指定查询渠道：信息价、厂商报价、或智诚信息价"
ASK_CHANNEL = "请明确指定查询渠道"
KNOWN, INFERRED, DEFAULTED = "已识别渠道：", "推断渠道：", "默认使用："
ENOUGH, FULL_SCORE, MOST, DEFAULT_CONFIDENCE = 0.3, 1.5, 0.95, 0.5
INTENTS = ("price_recommendation", "knowledge_qa", "other", "dangerous_sql")


def exact_channel(question: Column) -> Column:
    """The channel that a question names; null if none. Earlier channels win."""
    q = F.lower(F.coalesce(question, F.lit("")))
    out = F.lit(None).cast("string")
    for channel, words in reversed(NAMED.items()):
        named = F.lit(False)
        for w in words:
            named = named | q.contains(w)
        out = F.when(named, channel).otherwise(out)
    return out


def keyword_table(spark: SparkSession) -> DataFrame:
    """channel, keyword, weight and ord (place in its channel)."""
    return spark.createDataFrame([(c, w, x, i) for c, words in KEYWORDS.items() for i, (w, x) in enumerate(words.items())], "channel string, keyword string, weight double, ord int")


def keyword_scores(questions: DataFrame, keywords: DataFrame) -> DataFrame:
    """question_id, channel, score and matched (in the table's order) of every channel with a keyword in the question; keywords within others count too."""
    # lowered once, not for each pair; the keywords are a fixed list
    lowered = questions.select("question_id", F.lower("question").alias("_question"))
    met = lowered.join(F.broadcast(keywords.withColumn("_keyword", F.lower("keyword"))), F.col("_question").contains(F.col("_keyword")))
    ordered = F.array_sort(F.collect_list(F.struct("ord", "keyword")))
    return met.groupBy("question_id", "channel").agg(F.round(F.sum("weight"), 6).alias("score"), F.transform(ordered, lambda x: x["keyword"]).alias("matched"))


def entity_bonus(questions: DataFrame) -> DataFrame:
    """questions: question_id and the entity columns. question_id, channel, bonus, reason of every channel that the entities speak for."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    dated = has("startReleaseDate") | has("endReleaseDate")
    reason = F.when(has("brand"), BRAND_REASON)
    row = lambda channel, bonus: F.struct(F.lit(channel).alias("channel"), bonus.cast("double").alias("bonus"))
    rows = F.array(
        F.when(has("brand"), row("manufacturer_price", F.lit(0.5))),
        F.when(dated | (has("materialModelSpec") & has("materialName")), row("information_price", F.when(dated, 0.1).otherwise(0.2))),
        F.when(dated, row("zc_price", F.lit(0.15))),
    )
    return questions.select("question_id", reason.alias("reason"), F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("x")).select("question_id", "x.channel", "x.bonus", "reason")


def infer_channel(questions: DataFrame, keywords: DataFrame) -> DataFrame:
    """questions: question_id, question and entity columns. channel, confidence, reason, matched_keywords and suggestion of each."""
    scores = keyword_scores(questions, keywords).join(entity_bonus(questions), ["question_id", "channel"], "full")
    total = F.coalesce("score", F.lit(0.0)) + F.coalesce("bonus", F.lit(0.0))
    tie = F.array_position(F.array(*[F.lit(c) for c in TIE_ORDER]), F.col("channel"))
    matched = F.concat(F.coalesce("matched", F.array().cast("array<string>")), F.when(F.col("bonus").isNotNull() & F.col("reason").isNotNull(), F.array(F.concat(F.lit(ENTITY_MARK), "reason"))).otherwise(F.array().cast("array<string>")))
    best = scores.groupBy("question_id").agg(F.max(F.struct(F.round(total, 6).alias("score"), (-tie).alias("tie"), "channel", matched.alias("matched"))).alias("best"))
    joined = questions.join(best, "question_id", "left").withColumn("named", exact_channel(F.col("question")))
    score = F.col("best.score")
    enough = F.coalesce(score > ENOUGH, F.lit(False))
    named, has_name = F.col("named").isNotNull(), F.coalesce("materialName", F.lit("")) != ""
    first_word = F.element_at(F.create_map(*[F.lit(x) for c, w in NAMED.items() for x in (c, w[0])]), F.col("named"))
    none = F.array().cast("array<string>")
    return joined.select(
        "question_id",
        F.when(named, F.col("named")).when(enough, F.col("best.channel")).when(has_name, "information_price").otherwise("unknown").alias("channel"),
        F.when(named, 1.0).when(enough, F.least(score / FULL_SCORE, F.lit(MOST))).when(has_name, DEFAULT_CONFIDENCE).otherwise(0.0).alias("confidence"),
        F.when(named, F.concat(F.lit(REASON), first_word, F.lit(NAMED_END))).when(enough, F.concat(F.lit(REASON), F.array_join(F.slice("best.matched", 1, 3), ", "), F.lit(INFERRED_END))).when(has_name, DEFAULT_REASON).otherwise(UNKNOWN_REASON).alias("reason"),
        F.when(named, F.array(first_word)).when(enough, F.col("best.matched")).otherwise(none).alias("matched_keywords"),
        F.when(~named & ~enough, F.when(has_name, DEFAULT_SUGGESTION).otherwise(UNKNOWN_SUGGESTION)).alias("suggestion"),
    )


def channel_suggestion(inferred: DataFrame) -> DataFrame:
    """The text about an inferred channel, and whether to ask for confirmation (below 0.7, if known)."""
    c = F.col("confidence")
    name = F.element_at(F.create_map(*[F.lit(x) for pair in DISPLAY.items() for x in pair]), F.col("channel"))
    text = (
        F.when(c >= 1, F.concat(F.lit(KNOWN), name)).when(c >= 0.7, F.concat(F.lit(INFERRED), name, F.lit("（"), "reason", F.lit("）")))
        .when(c > 0, F.concat(F.lit(DEFAULTED), name, F.lit("，"), F.coalesce("suggestion", F.lit("")))).otherwise(F.coalesce("suggestion", F.lit(ASK_CHANNEL)))
    )
    return inferred.select("question_id", "channel", "confidence", text.alias("suggestion_text"), ((c < 0.7) & (F.col("channel") != "unknown")).alias("should_confirm"))


def normalize_label(output: Column, allowed: list[str], default: str) -> Column:
    """A model's answer as one of the allowed labels: itself, the first contained in it, the first alike without case, _ and -, else the default."""
    out = F.regexp_replace(F.coalesce(output, F.lit("")), r"(?U)^\s+|\s+$", "")
    plain = lambda s: F.translate(F.lower(s), "_-", "")
    labels = F.array(*[F.lit(a) for a in allowed])
    contained = F.get(F.filter(labels, lambda a: out.contains(a)), F.lit(0))
    alike = F.get(F.filter(labels, lambda a: plain(out).contains(plain(a)) | plain(a).contains(plain(out))), F.lit(0))
    return F.when(out == "", default).when(out.isin(*allowed), out).otherwise(F.coalesce(contained, F.when(plain(out) != "", alike), F.lit(default)))


def route_intent(label: Column) -> Column:
    """The workflow for a label; empty, unknown and ``other`` go to price recommendation."""
    return F.when(label.isin("price_recommendation", "knowledge_qa", "dangerous_sql"), label).otherwise("price_recommendation")


def unfenced(text: Column) -> Column:
    s = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s*(?:```)?\s*(?:json)?\s*|\s*```\s*$", "")
    return F.regexp_replace(s, r"(?m)^\s*//.*$", "")


def parse_fenced_json(text: Column) -> Column:
    """The object in a model's answer, with or without fences, as a map of strings; empty if it can't be read."""
    return F.coalesce(F.from_json(unfenced(text), "map<string,string>"), F.create_map().cast("map<string,string>"))


def lenient_kv_parse(text: Column) -> Column:
    """Pairs of a broken object: open quotes and braces are closed, braces dropped, pairs cut at commas and at their first colon. The last of equal keys holds."""
    strip = lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
    s = strip(F.coalesce(text, F.lit("")))
    quotes = F.length(s) - F.length(F.replace(s, F.lit('"'), F.lit("")))
    closed = F.when(s.endswith("}"), s).when(quotes % 2 == 1, F.regexp_replace(s, r'(?s)"[^"]*$', '"')).otherwise(s)
    body = F.regexp_replace(closed, r"^\{|\}$", "")
    pair = F.filter(F.transform(F.split(body, ","), strip), lambda p: p.contains(":"))
    bare = lambda x: F.regexp_replace(strip(x), "^[\"']+|[\"']+$", "")
    value = lambda p: F.translate(bare(F.regexp_replace(p, r"(?s)^[^:]*:", "")), "\n\r", "")
    entries = F.transform(pair, lambda p: F.struct(bare(F.regexp_replace(p, r"(?s):.*$", "")).alias("k"), F.when(F.lower(value(p)) != "null", strip(value(p))).alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["k"] == e["k"]))
    return F.map_from_entries(last)


def merge_entities(base: Column, extra: Column, allowed: list[str]) -> Column:
    """base with the allowed, non-empty values of extra over it; empty values of base are left out."""
    empty = F.create_map().cast("map<string,string>")
    full = lambda m: F.map_filter(F.coalesce(m, empty), lambda k, v: F.coalesce(v, F.lit("")) != "")
    new = F.map_filter(full(extra), lambda k, v: k.isin(*allowed))
    old = F.map_filter(full(base), lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.map_concat(old, new)
