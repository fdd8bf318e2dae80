"""Fuzzy matching of material names.

Names are cleaned and compared once for each distinct name; records only take over the scores. A query's candidates are the names of
its own matches, so no two queries' names meet.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: what is noise in a name (sizes, steel grades, processes), and the punctuation patterns
SIZES = r"(?U)\d+(?:\.\d+)?\s*(?:mm|cm|m)|\d+(?:\.\d+)?\s*[*xX]\s*\d+(?:\.\d+)?(?:\s*[*xX]\s*\d+(?:\.\d+)?)?"
GRADES = r"(?iU)Q\d{3}[A-Z]?|HRB\d{3}[A-Z]?|HPB\d{3}|SUS\d{3}|304L?|316L?"
PROCESSES = "热轧|冷轧|镀锌|酸洗|拉丝|镜面|抛光"
PUNCTUATION = {
    # what the first version's class really matches: its unescaped bracket ends it early
    "narrow": r"""[，。、"！!?：:；;（）()【】\[]/,_-+|\]""",
    "all": r"""[，。、"'！!?：:；;（）()【】\[\]/,_\-+|]""",
}
BLANKS = r"(?U)\s+"


@F.pandas_udf(StringType())
def half_width(names: pd.Series) -> pd.Series:
    """NFKC: full-width letters and digits become plain ones."""
    return names.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def core_name(name: Column, punctuation: str = "narrow", widths: bool = True) -> Column:
    """A name without case, punctuation, sizes, grades and processes; null and empty give ''. Without ``widths`` (names known to be plain) no Python runs."""
    s = half_width(name) if widths else name
    s = F.regexp_replace(F.regexp_replace(F.lower(s), r"(?U)^\s+|\s+$", ""), PUNCTUATION[punctuation], " ")
    s = F.regexp_replace(s, BLANKS, " ")
    for noise in (SIZES, GRADES, PROCESSES):
        s = F.regexp_replace(s, noise, " ")
    return F.coalesce(F.trim(F.regexp_replace(s, BLANKS, " ")), F.lit(""))


def core_names(names: DataFrame, column: str = "materialName", punctuation: str = "narrow", widths: bool = True) -> DataFrame:
    """Each distinct name and its core."""
    return names.select(column).distinct().withColumn("core", core_name(F.col(column), punctuation, widths))


def containment(a: Column, b: Column) -> Column:
    """1 if the shorter is in the longer, 0.5 if it is once blanks are taken out, else 0; 0 too if it has fewer than two characters."""
    swap = F.length(a) > F.length(b)
    short, long = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    plain = lambda s: F.replace(s, F.lit(" "), F.lit(""))
    score = F.when(F.length(short) < 2, 0.0).when(long.contains(short), 1.0).when(plain(long).contains(plain(short)), 0.5).otherwise(0.0)
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(score)


def grams(s: Column) -> Column:
    """The 2- and 3-grams of a string with single blanks in lower case, with repeats."""
    s = F.lower(F.regexp_replace(s, r"(?U)\s\s+", " "))
    of = lambda n: F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substring(s, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.concat(of(2), of(3))


def char_tfidf_cosine(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """queries: query_id, core. candidates: query_id, core, m (how many records have it). Gives query_id, core and cosine.

    Document frequencies count the query and its candidates with their multiplicity; idf is ln((1 + n) / (1 + df)) + 1.
    """
    asked = queries.select("query_id", F.col("core").alias("q_core"))
    own = asked.select("query_id", F.explode(grams(F.col("q_core"))).alias("gram")).groupBy("query_id", "gram").agg(F.count(F.lit(1)).alias("q_tf"))
    # grams of a name are made once, whatever queries have it
    names = candidates.select("core").distinct().select("core", F.explode(grams(F.col("core"))).alias("gram")).groupBy("core", "gram").agg(F.count(F.lit(1)).alias("tf"))
    terms = candidates.select("query_id", "core", "m").join(names, "core")
    totals = candidates.groupBy("query_id").agg((F.sum("m") + 1).alias("n"))
    df = terms.groupBy("query_id", "gram").agg(F.sum("m").alias("df"))
    weights = (
        df.join(own, ["query_id", "gram"], "full").join(totals, "query_id")
        .select("query_id", "gram", F.coalesce("q_tf", F.lit(0)).alias("q_tf"), (F.log((1 + F.col("n")) / (1 + F.coalesce("df", F.lit(0)) + F.when(F.col("q_tf") > 0, 1).otherwise(0))) + 1).alias("idf"))
    )
    q_norm = weights.groupBy("query_id").agg(F.sqrt(F.sum(F.pow(F.col("q_tf") * F.col("idf"), 2))).alias("q_norm"))
    scored = (
        terms.join(weights, ["query_id", "gram"])
        .groupBy("query_id", "core").agg(F.sum(F.col("tf") * F.col("q_tf") * F.col("idf") * F.col("idf")).alias("dot"), F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), 2))).alias("norm"))
        .join(q_norm, "query_id").select("query_id", "core", F.col("dot"), (F.col("norm") * F.col("q_norm")).alias("norms"))
    )
    out = candidates.select("query_id", "core").join(scored, ["query_id", "core"], "left")
    return out.select("query_id", "core", F.when(F.col("norms") > 0, F.col("dot") / F.col("norms")).otherwise(0.0).alias("cosine"))


def name_scores(queries: DataFrame, matches: DataFrame, alpha: float = 0.4, keep: float = 0.75, drop: float = 0.50, punctuation: str = "narrow", widths: bool = True) -> DataFrame:
    """queries: query_id, materialName. matches: query_id, materialName. Gives query_id, materialName, score and tag (keep, review or drop) of each distinct name."""
    asked = queries.select("query_id", core_name(F.col("materialName"), punctuation, widths).alias("core"))
    cores = core_names(matches, "materialName", punctuation, widths)
    counted = matches.groupBy("query_id", "materialName").agg(F.count(F.lit(1)).alias("m"))
    named = counted.join(cores, "materialName")
    candidates = named.groupBy("query_id", "core").agg(F.sum("m").alias("m"))
    cosine = char_tfidf_cosine(asked, candidates)
    joined = cosine.join(asked.select("query_id", F.col("core").alias("q_core")), "query_id")
    score = alpha * containment(F.col("q_core"), F.col("core")) + (1 - alpha) * F.col("cosine")
    least = keep + F.when(F.length(F.replace("q_core", F.lit(" "), F.lit(""))) <= 2, 0.05).otherwise(0.0)
    tagged = joined.withColumn("score", score).withColumn("tag", F.when(F.col("score") >= least, "keep").when(F.col("score") >= drop, "review").otherwise("drop"))
    return named.join(tagged, ["query_id", "core"]).select("query_id", "materialName", "score", "tag")


def fuzzy_match(queries: DataFrame, matches: DataFrame, **options) -> DataFrame:
    """The matches whose names score high enough for their query, with score and tag. Options as of name_scores. Rows with a null name are dropped."""
    scores = name_scores(queries, matches, **options).filter("tag <> 'drop'")
    return matches.join(scores, ["query_id", "materialName"])
