"""Filters, counts and limits of price records, for many queries at once.

A query is a row; an absent, null or empty field is no condition. Queries are joined to records on the channel, the name and the fields that must be
equal, so records that differ in one of these are never paired; the other conditions are evaluated in the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..durable import durable
from ..schemas import CHANNELS, FILTER_FIELDS
from .names import either_holds

EQUALITIES = ("materialModelSpec", "province", "city", "releaseDepartment", "brand", "supplyName", "grade")
SALTS = 32
TOKENS_PER_RECORD, SAFE_TOKENS = 120, 100_000
# fixed values: the service's names of the channels, the share of records a condition on a field is assumed to leave, and the fields' labels
SERVICE_NAMES = {"informaterial": "information_price", "factory": "manufacturer_price", "zhicheng": "zc_price"}
REDUCTION = {"materialName": 0.01, "materialModelSpec": 0.10, "province": 0.05, "city": 0.02, "minPrice": 0.30, "maxPrice": 0.30, "startReleaseDate": 0.20, "brand": 0.05}
OTHER_REDUCTION = 0.50
FIELD_LABELS = {"materialName": "材料名称", "province": "省份", "city": "城市", "materialModelSpec": "规格型号", "startReleaseDate": "开始日期", "endReleaseDate": "结束日期", "minPrice": "最低价", "maxPrice": "最高价", "brand": "品牌"}


def blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("")) == ""


def with_channel(queries: DataFrame) -> DataFrame:
    """Queries with the channel they are routed to: service names are translated, unknown ones become information prices."""
    names = F.create_map(*[F.lit(x) for pair in SERVICE_NAMES.items() for x in pair])
    known = F.when(F.col("channel").isin(*CHANNELS), F.col("channel"))
    return queries.withColumn("channel", F.coalesce(known, names[F.col("channel")], F.lit(CHANNELS[0])))


def select_channel(records: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id with every record of its channel."""
    return with_channel(queries).select("query_id", "channel").join(records, "channel")


#: the older names of the date bounds, still in use
DATE_KEYS = {"startReleaseDate": "startReleaseTime", "endReleaseDate": "endReleaseTime"}


def with_dates(queries: DataFrame) -> DataFrame:
    """Queries with both date bounds under their present names; a bound under its older name counts where the other is blank."""
    both = {new: F.coalesce(F.nullif(F.col(new), F.lit("")) if new in queries.columns else F.lit(None), F.col(old)) for new, old in DATE_KEYS.items() if old in queries.columns}
    return queries.withColumns(both) if both else queries


def names_asked(records: DataFrame, queries: DataFrame) -> DataFrame:
    """channel, materialName and _q: the queries, as structs, that each distinct name of a channel meets.

    Exact names are joined as they are. For the rest the distinct names in lower case and the distinct names asked for meet by their rarest common gram
    (``names.either_holds``); an empty name is in every other. Queries without a name meet all names of their channel, which are dealt to SALTS parts."""
    asked = with_dates(with_channel(queries))
    q = asked.select("channel", F.struct(*asked.columns).alias("_q"))
    name = F.col("_q.materialName")
    exact = F.coalesce(F.col("_q.matchMethod"), F.lit(1)) == 2
    # written: they are read several times, and records may be a view that is costly to make
    names = durable(records.select("channel", "materialName").distinct(), "names")
    named = names.filter("materialName is not null")
    equal = q.filter(exact & ~blank(name)).withColumn("materialName", name).join(named, ["channel", "materialName"])
    wanted = q.filter(~exact & ~blank(name)).withColumn("_wanted", F.lower(name))
    lowered = named.withColumn("_lower", F.lower("materialName"))
    pairs = either_holds(lowered.select("channel", F.col("_lower").alias("a")).distinct(), wanted.select("channel", F.col("_wanted").alias("b")).distinct())
    like = pairs.select("channel", F.col("a").alias("_lower"), F.col("b").alias("_wanted")).join(lowered, ["channel", "_lower"]).join(wanted, ["channel", "_wanted"])
    # at most one empty name in each channel
    empty = named.filter("materialName = ''").join(wanted, "channel")
    salt = F.pmod(F.xxhash64("materialName"), F.lit(SALTS)).cast("int")
    every = names.withColumn("_salt", salt).join(q.filter(blank(name)).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["channel", "_salt"])
    columns = ["channel", "materialName", "_q"]
    return equal.select(columns).unionByName(like.select(columns)).unionByName(empty.select(columns)).unionByName(every.select(columns))


def _condition(records: DataFrame, q: str = "_q") -> Column:
    """Whether a record of a fitting name meets the rest of the query in the struct column q."""
    field = lambda name: F.col(f"{q}.{name}")
    # a bound of 0 is no bound
    met = (F.coalesce(field("minPrice"), F.lit(0.0)) == 0) | (F.col("price") >= field("minPrice"))
    met = met & ((F.coalesce(field("maxPrice"), F.lit(0.0)) == 0) | (F.col("price") <= field("maxPrice")))
    for f in EQUALITIES:
        if f in records.columns:
            met = met & (blank(field(f)) | (F.col(f) == field(f)))
    met = met & (blank(field("startReleaseDate")) | (F.col("releaseDate") >= field("startReleaseDate")))
    return met & (blank(field("endReleaseDate")) | (F.col("releaseDate") <= field("endReleaseDate")))


def candidates(records: DataFrame, asked: DataFrame) -> DataFrame:
    """records with each query in ``asked`` (of ``names_asked``, a written table at best, as it is read twice) that has their channel and name, and whose
    equalities they meet but for equal hashes; adds _q.

    A query's equalities are part of the join's key. As queries set different ones, a record is looked up once for each set of them that its name is asked for with."""
    texts = lambda fields: {f.name for f in fields if f.name in EQUALITIES and isinstance(f.dataType, StringType)}
    keyed = sorted(texts(records.schema) & texts(asked.schema["_q"].dataType))
    bit = {f: 1 << i for i, f in enumerate(keyed)}
    key = lambda value: F.xxhash64("_set", *[F.when(F.col("_set").bitwiseAND(n) > 0, value(f)) for f, n in bit.items()])
    given = sum((F.when(blank(F.col(f"_q.{f}")), 0).otherwise(n) for f, n in bit.items()), F.lit(0))
    asked = asked.withColumnsRenamed({"channel": "_channel", "materialName": "_name"}).withColumn("_set", given)
    sets = asked.groupBy("_channel", "_name").agg(F.collect_set("_set").alias("_sets")).withColumnsRenamed({"_channel": "_c", "_name": "_n"})
    sought = records.join(sets, (F.col("channel") == F.col("_c")) & F.col("materialName").eqNullSafe(F.col("_n"))).withColumn("_set", F.explode("_sets"))
    sought = sought.withColumn("_key", key(F.col)).drop("_c", "_n", "_sets", "_set")
    wanted = asked.select("_channel", "_name", "_q", key(lambda f: F.col(f"_q.{f}")).alias("_wanted"))
    met = sought.join(wanted, (F.col("channel") == F.col("_channel")) & F.col("materialName").eqNullSafe(F.col("_name")) & (F.col("_key") == F.col("_wanted")))
    return met.select(*records.columns, "_q")


def filter_prices(records: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id with each record that meets the query.

    Names are compared once for each distinct name of a channel, not for each record; records are joined to the queries of their channel,
    name and equalities, and only the other conditions are left to test. A name that very many records have is split by adaptive execution.
    """
    asked = durable(names_asked(records, queries), "asked")
    return candidates(records, asked).filter(_condition(records)).select(F.col("_q.query_id").alias("query_id"), *records.columns)


def count_matches(matches: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, total_count (0 where nothing matches)."""
    counts = matches.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return queries.select("query_id").join(counts, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).cast("long").alias("total_count"))


def limit_per_query(matches: DataFrame, queries: DataFrame, order: str = "record_id", default: int = 10_000) -> DataFrame:
    """At most returnNumber matches of each query (0: none, only the count is wanted), in the given order."""
    limits = queries.select("query_id", F.coalesce("returnNumber", F.lit(default)).alias("_limit"))
    row = F.row_number().over(Window.partitionBy("query_id").orderBy(order))
    return matches.join(limits, "query_id").filter("_limit > 0").withColumn("_row", row).filter("_row <= _limit").drop("_row", "_limit")


def volume_report(counts: DataFrame) -> DataFrame:
    """counts: query_id, total_count. Adds estimated_tokens, level, can_process and safe_count."""
    n = F.col("total_count")
    level = F.when(n <= 100, "optimal").when(n <= 1000, "acceptable").when(n <= 10_000, "too_large").otherwise("unacceptable")
    return counts.select("query_id", "total_count", (n * TOKENS_PER_RECORD).alias("estimated_tokens"), level.alias("level"), (n <= 1000).alias("can_process"), F.lit(SAFE_TOKENS // TOKENS_PER_RECORD).alias("safe_count"))


def missing_filters(queries: DataFrame, fields: tuple[str, ...] = FILTER_FIELDS) -> Column:
    """The fields without a value, in their order. A price bound of 0 counts as absent."""
    empty = [F.when(blank(F.col(f)) | ((F.coalesce(F.try_to_number(F.col(f).cast("string"), F.lit("S9999999999.99")), F.lit(1)) == 0) if f in ("minPrice", "maxPrice") else F.lit(False)), F.lit(f)) for f in fields if f in queries.columns]
    return F.filter(F.array(*empty), lambda x: x.isNotNull())


def suggest_filters(queries: DataFrame, counts: DataFrame) -> DataFrame:
    """The first three missing fields of queries with too many matches; none for the others."""
    joined = queries.join(counts.select("query_id", "total_count"), "query_id")
    first = F.slice(missing_filters(queries), 1, 3)
    return joined.select("query_id", "total_count", F.when(F.col("total_count") > 1000, first).otherwise(F.array().cast("array<string>")).alias("suggested"))


def refinement_message(queries: DataFrame, counts: DataFrame) -> DataFrame:
    """A text for each query: matches, tokens, the conditions given and up to five that could be added (brand only for manufacturer prices)."""
    fields = [f for f in FIELD_LABELS if f in queries.columns]
    labels = F.create_map(*[F.lit(x) for pair in FIELD_LABELS.items() for x in pair])
    given = F.filter(F.array(*[F.when(~blank(F.col(f)), F.concat(F.lit(FIELD_LABELS[f] + ": "), F.col(f).cast("string"))) for f in fields]), lambda x: x.isNotNull())
    open_fields = F.filter(missing_filters(queries, tuple(fields)), lambda f: (f != "brand") | (F.col("channel") == "manufacturer_price"))
    joined = queries.join(counts.select("query_id", "total_count"), "query_id")
    text = F.concat_ws(
        "\n",
        F.format_string("%d records, about %d tokens (limit %d)", F.col("total_count"), F.col("total_count") * TOKENS_PER_RECORD, F.lit(SAFE_TOKENS)),
        F.concat(F.lit("given: "), F.array_join(given, ", ")),
        F.concat(F.lit("add: "), F.array_join(F.transform(F.slice(open_fields, 1, 5), lambda f: labels[f]), ", ")),
    )
    return joined.select("query_id", text.alias("message"))


def validate_ranges(queries: DataFrame) -> DataFrame:
    """price_ok: no bound is missing a partner or 0 <= min < max. date_ok: likewise, both dates real and start before end."""
    low, high = F.col("minPrice"), F.col("maxPrice")
    price = F.when(low.isNull() | high.isNull(), True).otherwise((low >= 0) & (low < high))
    start, end = (F.try_to_date(F.col(c), "yyyy-MM-dd") for c in ("startReleaseDate", "endReleaseDate"))
    absent = blank(F.col("startReleaseDate")) | blank(F.col("endReleaseDate"))
    date = F.when(absent, True).otherwise(F.coalesce(start < end, F.lit(False)))
    return queries.select("query_id", price.alias("price_ok"), date.alias("date_ok"))


def estimate_reduction(queries: DataFrame, matches: DataFrame, records: DataFrame) -> DataFrame:
    """Of every condition a query sets: the assumed share of records it leaves, and the share that all conditions of the query really leave of its channel."""
    factors = F.create_map(*[F.lit(x) for pair in REDUCTION.items() for x in pair])
    fields = [f for f in (*REDUCTION, "endReleaseDate", "releaseDepartment") if f in queries.columns]
    asked = with_channel(queries)
    given = asked.select("query_id", "channel", F.explode(F.filter(F.array(*[F.when(~blank(F.col(f)), F.lit(f)) for f in fields]), lambda x: x.isNotNull())).alias("field"))
    total = records.groupBy("channel").agg(F.count(F.lit(1)).alias("_all"))
    found = count_matches(matches, queries)
    joined = given.join(found, "query_id").join(total, "channel", "left")
    return joined.select("query_id", "field", F.coalesce(factors[F.col("field")], F.lit(OTHER_REDUCTION)).alias("assumed"), F.round(F.col("total_count") / F.col("_all"), 6).alias("actual"))


def direct_queries(requests: DataFrame, extras: DataFrame | None = None) -> DataFrame:
    """requests: query_id, channel, materials (array of structs materialName, province, city). The first material of each as a query; extras (query_id and the same three fields) fill in non-empty values."""
    first = requests.select("query_id", "channel", F.get("materials", F.lit(0)).alias("m"))
    names = ("materialName", "province", "city")
    if extras is not None:
        first = first.join(extras.select("query_id", F.struct(*names).alias("e")), "query_id", "left")
        values = [F.coalesce(F.nullif(F.col(f"e.{n}"), F.lit("")), F.nullif(F.col(f"m.{n}"), F.lit(""))).alias(n) for n in names]
    else:
        values = [F.nullif(F.col(f"m.{n}"), F.lit("")).alias(n) for n in names]
    return with_channel(first).select("query_id", "channel", *values)


def empty_result_status(queries: DataFrame, matches: DataFrame) -> DataFrame:
    """success, message and count of each query; no match is a row with success false."""
    counted = count_matches(matches, queries)
    ok = F.col("total_count") > 0
    return counted.select("query_id", ok.alias("success"), F.when(ok, "ok").otherwise("no matching records").alias("message"), "total_count")
