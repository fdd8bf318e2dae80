"""URL filters from dated lists: a temporal list join.

A list is a log of entries: from a day on, a rule (a domain, a host or an address prefix) blocks, allows or is withdrawn. Each entry
holds until the next of the same rule: the log becomes validity intervals. Every capture is judged by the entries active when it was
fetched. An address has few rules that can match it: its host, the domains above it, and beginnings that end at a slash, of the
lengths that prefix rules of its host have. So the as-of join is an equi-join on the rule with a test of the interval, never a scan of the list, and an
address of very many path segments has no more candidates than its host has lengths; of the rules that are active, the
most specific one decides (longest prefix, then host, then longest domain).

The list may be large, so it is not broadcast by hint: Spark broadcasts it if it is small, and splits hot hosts of a sort-merge join.
Captures of one address and day are judged once each; verdicts are joined to no text.

Defined cases: an address without a host (null, empty, not absolute) and a capture without a time are matched by nothing and allowed,
with null rule; entries without a rule, day or action are ignored; of entries of one rule and day the greatest action name holds
(allow < block < withdraw); repeated captures give a row each; an empty list allows everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..durable import durable

# user information before the last @ is passed over; browsers take a backslash for a slash; a host may be an address in brackets, and end with dots
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/\\?#]*@)?(\[[^/\\?#\]]*\]|[^/\\:?#@\[]*[^/\\:?#@\[.])\.*(?:[:/\\?#]|$)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/\\?#]+[/\\]([^?#]*)"


def host_of(url: Column) -> Column:
    """The host in lower case; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """entries: rule, day, action (block, allow or withdraw). Gives rule, action, valid_from, valid_to (exclusive; null: still valid)."""
    day = entries.dropna(subset=["rule", "day", "action"]).groupBy("rule", "day").agg(F.max("action").alias("action"))
    following = F.lead("day").over(Window.partitionBy("rule").orderBy("day"))
    return day.select("rule", "action", F.col("day").alias("valid_from"), following.alias("valid_to")).filter("action <> 'withdraw'")


def host_rules(host: Column) -> Column:
    """The rules for a host and the domains above it, with their precedence, as an array of structs (rule, rank)."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.struct(F.concat(F.lit("domain:"), F.array_join(F.slice(labels, -k, k), ".")).alias("rule"), k.cast("long").alias("rank")))
    exact = F.array(F.struct(F.concat(F.lit("host:"), host).alias("rule"), F.lit(10_000).cast("long").alias("rank")))
    return F.when(host.isNotNull(), F.concat(domains, exact))


def prefix_rules(asked: DataFrame, listed: DataFrame) -> DataFrame:
    """asked: url, fetched, host. The beginnings of each address that have the length of a prefix rule of its host: url, fetched, rule, rank."""
    rule = F.substring("rule", len("prefix:") + 1, 2**31 - 1)
    lengths = listed.filter(F.col("rule").startswith("prefix:") & F.col("rule").endswith("/")).select(F.substring_index(rule, "/", 1).alias("host"), F.length(rule).alias("n")).distinct()
    address = F.concat("host", F.lit("/"), F.translate(F.regexp_extract("url", PATH, 1), "\\", "/"))
    met = asked.withColumn("address", address).join(lengths, "host").filter(F.length("address") >= F.col("n"))
    return met.select("url", "fetched", F.concat(F.lit("prefix:"), F.substring("address", F.lit(1), F.col("n"))).alias("rule"), (F.col("n") + 10_001).cast("long").alias("rank"))


def judge(captures: DataFrame, entries: DataFrame, key: str = "capture_id") -> DataFrame:
    """captures: ``key``, url, fetched (a date). Gives ``key``, url, fetched, verdict (block or allow) and the rule that decided, or null."""
    asked = captures.select("url", "fetched").dropna().distinct().withColumn("host", host_of(F.col("url")))
    listed = durable(intervals(entries), "intervals")  # read twice
    hosts = asked.select("url", "fetched", F.explode(host_rules(F.col("host"))).alias("c")).select("url", "fetched", "c.rule", "c.rank")
    active = hosts.unionByName(prefix_rules(asked, listed)).join(listed, "rule").filter((F.col("valid_from") <= F.col("fetched")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to"))))
    best = active.groupBy("url", "fetched").agg(F.max(F.struct("rank", "rule", "action")).alias("best"))
    out = captures.select(key, "url", "fetched").join(best, ["url", "fetched"], "left")
    return out.select(key, "url", "fetched", F.coalesce("best.action", F.lit("allow")).alias("verdict"), F.col("best.rule").alias("rule"))


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages have no fetch time: each gets a day of 2024 from its id."""
    return pages.select("page_id", "url", F.expr("date_add(DATE'2024-01-01', cast(page_id * 37 % 366 as int))").alias("fetched"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A dated list from the addresses of the pages: hosts are blocked and later withdrawn, some domains blocked or allowed, some directories allowed."""
    hosts = pages.select(host_of(F.col("url")).alias("host"), F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^/?#]+/)", 1).alias("dir")).filter("host is not null")
    host = hosts.select("host").distinct()
    number = F.length("host") * 29 + F.ascii("host") * 13 + F.ascii(F.substring("host", 4, 1)) * 7
    entry = lambda rule, shift, action: F.struct(rule.alias("rule"), F.date_add(F.lit("2024-01-01").cast("date"), ((number + shift) % 366).cast("int")).alias("day"), F.lit(action).alias("action"))
    name = F.concat(F.lit("host:"), "host")
    domain = F.concat(F.lit("domain:"), F.substring_index("host", ".", -3))
    on_hosts = host.filter(number % 3 == 0).select(F.explode(F.array(entry(name, 0, "block"), entry(name, 90, "withdraw"), entry(name, 200, "block"))).alias("e"))
    on_domains = host.filter(number % 4 == 1).select(F.explode(F.array(entry(domain, 30, "block"), entry(domain, 150, "allow"))).alias("e"))
    on_dirs = hosts.filter((number % 3 == 0) & (F.col("dir") != "")).distinct().select(entry(F.concat(F.lit("prefix:"), "host", "dir"), 45, "allow").alias("e"))
    return on_hosts.unionByName(on_domains).unionByName(on_dirs).select("e.*")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture, judged by the list drawn from all pages."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(captures_of(pages), entries_of(pages), "page_id").withColumn("fetched", F.col("fetched").cast("string"))


ORACLE_SQL = r"""
WITH captures AS (SELECT page_id, url, DATE '2024-01-01' + (page_id * 37 % 366)::INTEGER AS fetched, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/\\?#]*@)?(\[[^/\\?#\]]*\]|[^/\\:?#@\[]*[^/\\:?#@\[.])\.*(?:[:/\\?#]|$)', 1)), '') AS host,
    '/' || translate(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/\\?#]+[/\\]([^?#]*)', 1), '\', '/') AS path FROM pages),
hosts AS (SELECT host, regexp_extract(url, '^[a-z]+://[^/]+(/[^/?#]+/)', 1) AS dir, length(host) * 29 + ascii(host) * 13 + ascii(substr(host, 4, 1)) * 7 AS number FROM captures WHERE host IS NOT NULL),
rules AS (
    SELECT 'host:' || host AS rule, number + s.shift AS n, s.action FROM (SELECT DISTINCT host, number FROM hosts) h, (VALUES (0, 'block'), (90, 'withdraw'), (200, 'block')) s(shift, action) WHERE number % 3 = 0
    UNION ALL SELECT 'domain:' || regexp_extract(host, '((?:[^.]*[.]){0,2}[^.]*)$', 1), number + s.shift, s.action FROM (SELECT DISTINCT host, number FROM hosts) h, (VALUES (30, 'block'), (150, 'allow')) s(shift, action) WHERE number % 4 = 1
    UNION ALL SELECT DISTINCT 'prefix:' || host || dir, number + 45, 'allow' FROM hosts WHERE number % 3 = 0 AND dir <> ''),
daily AS (SELECT rule, DATE '2024-01-01' + (n % 366)::INTEGER AS day, max(action) AS action FROM rules GROUP BY 1, 2),
spans AS (SELECT rule, action, day AS valid_from, lead(day) OVER (PARTITION BY rule ORDER BY day) AS valid_to FROM daily),
judged AS (SELECT c.page_id, s.rule, s.action,
      CASE WHEN s.rule LIKE 'domain:%' THEN len(string_split(s.rule, '.')) WHEN s.rule LIKE 'host:%' THEN 10000 ELSE 10000 + len(string_split(s.rule, '/')) END AS rank
    FROM captures c JOIN spans s ON s.action <> 'withdraw' AND s.valid_from <= c.fetched AND (s.valid_to IS NULL OR c.fetched < s.valid_to)
      AND (s.rule = 'host:' || c.host OR (s.rule LIKE 'domain:%' AND ('.' || c.host) LIKE ('%.' || substr(s.rule, 8))) OR (s.rule LIKE 'prefix:%' AND starts_with(c.host || c.path, substr(s.rule, 8)))))
SELECT c.page_id, c.url, c.fetched::VARCHAR AS fetched, coalesce(j.action, 'allow') AS verdict, j.rule
FROM captures c LEFT JOIN (SELECT page_id, arg_max(action, rank) AS action, arg_max(rule, rank) AS rule FROM judged GROUP BY 1) j ON c.page_id = j.page_id
"""
