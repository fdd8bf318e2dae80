"""Mixing sources to target weights by hash thresholds.

Every row has a hash that its key and text decide. A source's words are summed by hash bucket; the running sum over a source's buckets
shows the bucket in which its budget ends. Only the rows of that bucket are summed again by the next bits of the hash, LEVELS times,
until a bucket is one hash value. Rows below the threshold are taken; nothing is sorted but a source's histogram of at most
2 ** BITS rows. Thresholds are nested: a larger budget takes a superset.

A budget above the source's words takes every row once, and rows below the threshold of the remainder a second time.

Defined cases: a null text has 0 words; a null source is a source of its own, the last; a null key counts as the word ``null``, a null text as the empty one;
equal rows are numbered, and each number has a hash of its own, so a source made of such rows meets its target too (in ``mixed``, rows with equal
keys and texts stand or fall together); a source without words has target 0 and takes nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..durable import durable
from .text import HASH_BITS, key_hash, key_hash_sql, text_of, words

BITS, LEVELS = 13, 4  # 4 x 13 bits are the whole hash
CHUNK = 10_000  # equal rows that one task writes
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0


def targets(totals: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """totals: source, source_size. Adds target: ``share`` of all sizes dealt by weight, at most ``most`` times a source's size, the excess dealt again by weight until none is above.

    The fixed point of that dealing is a water level: sources sorted by limit / weight are held at their limits up to the first whose
    share of the rest stays below. ``totals`` has one row for each source, never one for each document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy(F.col("_limit") / F.col("_weight"), "_rank")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = (
        totals.withColumn("_rank", F.row_number().over(by_name) - 1)
        .withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_rank") % len(weights) + 1))
        .withColumn("_limit", F.col("source_size") * most)
        .withColumn("_all", F.sum("source_size").over(everything) * share)
        .withColumn("_left", F.col("_all") - F.coalesce(F.sum("_limit").over(before), F.lit(0.0)))
        .withColumn("_weights", F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
        .withColumn("_held", F.col("_limit") * F.col("_weights") <= F.col("_left") * F.col("_weight"))
    )
    first = F.struct((F.col("_limit") / F.col("_weight")).alias("at"), F.col("_rank").alias("r"), F.col("_left").alias("left"), F.col("_weights").alias("weights"))
    level = ranked.withColumn("_free", F.min(F.when(~F.col("_held"), first)).over(everything))
    target = F.when(F.col("_held"), F.col("_limit")).otherwise(F.col("_free.left") * F.col("_weight") / F.col("_free.weights"))
    return level.select("source", "source_size", target.alias("target"))


def _digit(h: Column, level: int) -> Column:
    return F.shiftright(h, HASH_BITS - BITS * (level + 1)).bitwiseAND(2**BITS - 1)


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """rows: source, size, h. budgets: source, budget. Gives source, threshold: the sizes of rows with h < threshold come as near to the budget as a threshold can; with the next hash value they'd be above.

    Both results have one row for each source. Level 0 reads all rows, every further level only the rows of the boundary bucket.
    """
    state = budgets.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(False).alias("whole"))
    for level in range(LEVELS):
        shift = HASH_BITS - BITS * level
        inside = rows.join(state, rows["source"].eqNullSafe(state["source"])).select(rows["source"], rows["size"], rows["h"], "budget", "prefix", "whole")
        if level:
            inside = inside.filter(~F.col("whole") & (F.shiftright("h", shift) == F.col("prefix")))
        histogram = inside.groupBy("source", _digit(F.col("h"), level).alias("digit")).agg(F.sum("size").alias("size"), F.first("budget").alias("budget"))
        running = F.sum("size").over(Window.partitionBy("source").orderBy("digit"))
        over = histogram.withColumn("_running", running).filter(F.col("_running") > F.col("budget"))
        edge = over.groupBy("source").agg(F.min(F.struct("digit", "size", (F.col("_running") - F.col("size")).alias("below"))).alias("edge"))
        joined = state.join(edge.select(F.col("source").alias("_source"), "edge"), F.col("source").eqNullSafe(F.col("_source")), "left")
        found = F.col("edge").isNotNull()
        nearer = ((F.col("budget") - F.col("edge.below")) * 2 >= F.col("edge.size")).cast("long") if level == LEVELS - 1 else F.lit(0)
        state = durable(
            joined.select(
                "source",
                F.when(found, F.col("budget") - F.col("edge.below")).otherwise(F.col("budget")).alias("budget"),
                F.when(found, F.shiftleft("prefix", BITS) + F.col("edge.digit") + nearer).otherwise(F.shiftleft(F.col("prefix") + (1 if level == 0 else 0), BITS)).alias("prefix"),
                (F.col("whole") | ~found).alias("whole"),
            ),
            f"mixing-level{level}",
        )
    return state.select("source", F.col("prefix").alias("threshold"))


def _plan(rows: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """rows: source, size, h. One row for each source: source, source_size, target, once (whether all its rows are taken once) and threshold."""
    if most > 2:
        raise ValueError("a row is taken twice at most")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = durable(targets(totals, weights, share, most).withColumn("once", F.col("target") >= F.col("source_size")), "mixing-targets")
    edges = thresholds(rows, plan.select("source", (F.col("target") - F.when(F.col("once"), F.col("source_size")).otherwise(0)).alias("budget")))
    joined = plan.join(edges.select(F.col("source").alias("_source"), "threshold"), F.col("source").eqNullSafe(F.col("_source")))
    return durable(joined.drop("_source"), "mixing-plan")


def _copies(h: Column, once: Column, threshold: Column) -> Column:
    """How often a row is taken: 0, 1 or 2 times."""
    return once.cast("int") + (h < threshold).cast("int")


def _hash(docs: DataFrame, key: str) -> Column:
    """The key alone need not tell rows apart: keys may be null or repeated."""
    return key_hash(docs[key], F.md5(text_of(docs["text"])))


def _sized(docs: DataFrame, key: str) -> DataFrame:
    return durable(docs.select(F.col(key).alias("key"), "source", words(F.col("text")).alias("size"), _hash(docs, key).alias("h")), "mixing-rows")


def _numbered(rows: DataFrame) -> DataFrame:
    """rows: key, source, size, h. The same rows, equal ones with different hashes. They are counted before they meet, and are rows again in several tasks."""
    counted = rows.groupBy("key", "source", "size", "h").agg(F.count(F.lit(1)).alias("_n"))
    parts = counted.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(CHUNK))))
    each = F.explode(F.sequence(F.col("_part") + 1, F.least(F.col("_part") + CHUNK, F.col("_n"))))
    single = parts.repartition("h", "_part").withColumn("_number", each)
    return single.select("key", "source", "size", F.when(F.col("_number") == 1, F.col("h")).otherwise(key_hash(F.col("h"), F.col("_number"))).alias("h"))


def mix(docs: DataFrame, key: str = "doc_id", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """docs: ``key``, text, source. Gives ``key``, source, size, source_size, target and taken of every row."""
    rows = durable(_numbered(_sized(docs, key)), "mixing-numbered")
    plan = _plan(rows, weights, share, most).withColumnRenamed("source", "_source")
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    taken = F.col("size") * _copies(F.col("h"), F.col("once"), F.col("threshold"))
    return joined.select(F.col("key").alias(key), "source", "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame, key: str = "doc_id", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The rows of docs, with all their columns, as often as the mix takes them. The plan, a row for each source, is all that the texts are joined to."""
    plan = _plan(_sized(docs, key), weights, share, most).select(F.col("source").alias("_mix_source"), F.struct("once", "threshold").alias("_mix_plan"))
    copies = _copies(_hash(docs, key), F.col("_mix_plan.once"), F.col("_mix_plan.threshold"))
    joined = docs.join(plan, docs["source"].eqNullSafe(plan["_mix_source"]))
    return joined.withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*[docs[c] for c in docs.columns])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed_sql(docs: str) -> str:
    """The common table expressions of DuckDB SQL for ``mix`` over the table ``docs``; the last, mixed, has doc_id, size, source_size, target and copies."""
    return f"""
hashed AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, {key_hash_sql("coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))")} AS h0 FROM {docs}),
sized AS (SELECT doc_id, source, size, CASE WHEN number = 1 THEN h0 ELSE {key_hash_sql("h0::VARCHAR || ':' || number::VARCHAR")} END AS h FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size, h0) AS number FROM hashed)),
totals AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
weighed AS (SELECT *, [3.0, 1.0, 2.0][rank % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS most FROM totals),
stepped AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(most) OVER prior, 0) AS rest, (sum(weight) OVER ()) - coalesce(sum(weight) OVER prior, 0) AS weights
            FROM weighed WINDOW prior AS (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
free AS (SELECT rest, weights FROM stepped WHERE most * weights > rest * weight ORDER BY most / weight, rank LIMIT 1),
plan AS (SELECT s.source, s.source_size, CASE WHEN s.most * s.weights <= s.rest * s.weight THEN s.most ELSE f.rest * s.weight / f.weights END AS target FROM stepped s LEFT JOIN free f ON true),
run AS (SELECT d.*, p.source_size, p.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 2 - sum(d.size) OVER (PARTITION BY d.source, d.h) AS twice
        FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
mixed AS (SELECT *, (target >= source_size)::BIGINT + (twice <= 2 * CASE WHEN target >= source_size THEN target - source_size ELSE target END)::BIGINT AS copies FROM run)"""


ORACLE_SQL = f"WITH {mixed_sql('documents')[1:]} SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken FROM mixed"
