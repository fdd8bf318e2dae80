"""Exact top-k search by inner product as a Voronoi kNN join.

The vectors with the largest inner products are the nearest ones once each data vector gets one more coordinate that makes all lengths
equal (and queries a zero there): d^2 = |q|^2 + M^2 - 2 q.s. Around a bounded number of pivots, data and queries fall into cells. Each
cell of data is summed up by its k + 1 smallest distances to the pivot; with the triangle inequality the
summaries bound the distance within which a query group's k + 1 nearest must lie, before any pair is compared (Lu et al., 2012). Data are
packed into blocks of BLOCK vectors of a cell; a block goes only to the query groups that its distance bounds cannot rule out, and
meets their queries, in blocks too, in one matrix product. Each meeting keeps k + 1 rows a query; of the k + 1 best of these, the query's own
row goes, or else the last.

A cell is split into as many blocks as it needs, and its meetings are dealt to SALTS tasks, so that neither a popular cell nor many equal ids,
vectors or rows fill one task. There is a pivot for every ROWS_A_PIVOT rows, PIVOTS at least and MOST_PIVOTS at most; summaries have k + 1
distances a pivot. Products are exact: floats are used only while all sums stay below 2 ** 53, else 64-bit integers.

Defined cases: a vector that is null or holds a null or a component that isn't finite takes no part; shorter vectors count as padded with zeros; an
empty vector scores 0 with all; rows with equal ids are candidates and queries each, and only a query's own row is none of its candidates; a
null id takes no part; ties go to the smaller id; fewer candidates than k give fewer rows; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..durable import durable
from .text import key_hash

PIVOTS, MOST_PIVOTS, ROWS_A_PIVOT = 32, 512, 1 << 16
BLOCK = 1024
SALTS = 16
SCALE = 64
SLACK = 1e-6  # of a distance, relative to the largest; bounds are widened by it against rounding


def quantised(df: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """id and v: floor(scale * x) of every component, as longs. Rows that take no part are left out."""
    x = F.transform(vector, lambda c: c.cast("double"))
    usable = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return df.filter(F.coalesce(usable, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _matrix(values: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(values), dim), np.int64)
    for row, v in zip(out, values, strict=True):
        row[: len(v)] = v
    return out


def _distances(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to the pivots, in one coordinate more; pivots are data vectors lifted likewise."""
    lifted = np.column_stack([x.astype(float), extra])
    square = (lifted**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * lifted @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def meetings(data: DataFrame, queries: DataFrame, k: int, pivots: int | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame, int, bool] | None:
    """Blocks of data, each for every query cell that may need it (cell, ids, vectors), and blocks of queries (cell, q_rows, q_ids, q_vectors); the
    number of dimensions, and whether floats are exact. None if there is nothing to find."""
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    size = data.agg(F.max(F.size("v")).alias("dim"), F.max(square).alias("norm"), F.count(F.lit(1)).alias("n")).first()
    widest = queries.agg(F.max(F.size("v")).alias("dim"), F.max(square).alias("norm")).first()
    if not size["n"] or widest["dim"] is None:
        return None
    dim, top = max(size["dim"], widest["dim"], 1), float(size["norm"])
    exact = max(top, float(widest["norm"])) < 2.0**52
    pivots = pivots or min(MOST_PIVOTS, max(PIVOTS, size["n"] // ROWS_A_PIVOT))

    # pivots: a bounded sample of the data, by hash of the id
    chosen = data.withColumn("h", key_hash(F.lit("pivot"), F.col("id"))).orderBy("h", "id").limit(pivots).collect()
    base = np.unique(_matrix(pd.Series([r["v"] for r in chosen]), dim), axis=0)
    lift = lambda m: np.sqrt(np.maximum(top - (m.astype(float) ** 2).sum(1), 0))
    centres = np.column_stack([base.astype(float), lift(base)])
    slack = SLACK * (np.sqrt(top) + np.sqrt(float(widest["norm"])) + 1)

    def cells(lifted: bool):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n = 0
            for part in parts:
                for at in range(0, len(part), 4096):
                    some = part.iloc[at : at + 4096]
                    x = _matrix(some["v"], dim)
                    d = _distances(x, lift(x) if lifted else np.zeros(len(x)), centres)
                    near = d.argmin(1)
                    yield pd.DataFrame({"id": some["id"].to_numpy(), "v": some["v"].to_numpy(), "cell": near, "d": d[np.arange(len(x)), near], "n": np.arange(n, n + len(x))})
                    n += len(x)

        return run

    kind = "id long, v array<long>, cell int, d double, n long"
    own = durable(data.mapInPandas(cells(True), kind), "knn-data")
    asked = durable(queries.mapInPandas(cells(False), kind).withColumn("row", F.monotonically_increasing_id()), "knn-queries")

    # summaries: of each cell of data the k + 1 smallest distances to the pivot; the query's own row may be one of them
    def nearest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least = pd.DataFrame({"cell": np.zeros(0, "int32"), "d": np.zeros(0)})
        for part in parts:
            least = pd.concat([least, part]).sort_values("d").groupby("cell").head(k + 1)
        yield least

    ranked = own.select("cell", "d").mapInPandas(nearest, "cell int, d double").withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("d")))
    near = ranked.filter(F.col("r") <= k + 1).select("cell", "d").toPandas()
    between = _distances(base, lift(base), centres)
    # a query has no lift, so its distance to a pivot is taken as it is
    reach = {r["cell"]: (r["near"], r["far"]) for r in asked.groupBy("cell").agg(F.min("d").alias("near"), F.max("d").alias("far")).collect()}
    limit = {}
    for cell, (_, far) in reach.items():
        bounds = np.sort(far + between[cell][near["cell"].to_numpy(int)] + near["d"].to_numpy())
        limit[cell] = bounds[k] + slack if len(bounds) > k else np.inf

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part, out = part.sort_values(["d", "id"]), []
        for at in range(0, len(part), block):
            some = part.iloc[at : at + block].sort_values("id")
            rows = some["row"].to_numpy("<i8").tobytes() if "row" in some else b""
            out.append((int(some["cell"].iloc[0]), float(some["d"].min()), float(some["d"].max()), rows, some["id"].to_numpy("<i8").tobytes(), _matrix(some["v"], dim).astype("<i8").tobytes()))
        return pd.DataFrame(out, columns=["cell", "near", "far", "rows", "ids", "vectors"])

    def blocks_of(rows: DataFrame) -> DataFrame:
        """Each cell cut by hash into slices of about ``block`` rows; n, a row's number in its task, tells equal rows apart."""
        counts = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}  # one row for each pivot
        slices = F.create_map(*[F.lit(int(x)) for c, n in counts.items() for x in (c, -(-n // block))])
        return rows.withColumn("slice", F.pmod(F.xxhash64("id", "v", "n"), slices[F.col("cell")])).groupBy("cell", "slice").applyInPandas(pack, packed)

    packed = "cell int, near double, far double, rows binary, ids binary, vectors binary"

    blocks, query_blocks = blocks_of(own), blocks_of(asked)

    def wanted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for row in part.itertuples(index=False):
                for cell, (_, far) in reach.items():
                    # |q s| >= |p_q p_s| - |q p_q| - |s p_s|, and >= |s p_s| - |p_q p_s| - |q p_q|
                    gap = max(between[cell][row.cell] - far - row.far, row.near - between[cell][row.cell] - far)
                    if gap <= limit[cell]:
                        rows.append((cell, row.ids, row.vectors))
            yield pd.DataFrame(rows, columns=["cell", "ids", "vectors"])

    dealt = blocks.mapInPandas(wanted, "cell int, ids binary, vectors binary")
    return dealt, query_blocks.select("cell", F.col("rows").alias("q_rows"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")), dim, exact


def top_k(data: DataFrame, queries: DataFrame, k: int, pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """Both: id (long), v (array of longs); queries are rows of data. Gives query_id, rank, vec_id and score, the k best of data for each query but its own row."""
    met = meetings(data, queries, k, pivots, block)
    if met is None:
        return data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dealt, query_blocks, dim, exact = met
    salted = query_blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    meet = dealt.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), ["cell", "salt"])

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                ids, q_ids, q_rows = (np.frombuffer(x, "<i8") for x in (row.ids, row.q_ids, row.q_rows))
                s, q = (np.frombuffer(x, "<i8").reshape(-1, dim) for x in (row.vectors, row.q_vectors))
                scores = (q.astype(float) @ s.T.astype(float)).astype(np.int64) if exact else q @ s.T
                hits = [_best(score, k + 1) for score in scores]
                n = [len(x) for x in hits]
                place = np.concatenate(hits)
                yield pd.DataFrame(
                    {"row": np.repeat(q_rows, n), "query_id": np.repeat(q_ids, n), "own": np.repeat((q * q).sum(1), n), "vec_id": ids[place], "score": scores[np.repeat(np.arange(len(q)), n), place]}
                )

    local = meet.mapInPandas(solve, "row long, query_id long, own long, vec_id long, score long")
    by_row = Window.partitionBy("row")
    best = local.withColumn("r", F.row_number().over(by_row.orderBy(F.col("score").desc(), "vec_id"))).filter(F.col("r") <= k + 1)
    # the query's own row; of rows like it any one
    itself = F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("r"))).over(by_row)
    ranked = best.withColumn("itself", F.coalesce(itself, F.lit(k + 1))).filter("r <> itself")
    return ranked.select("query_id", (F.col("r") - (F.col("r") > F.col("itself")).cast("int")).alias("rank"), "vec_id", "score")


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest, largest first; of equal ones the first places."""
    if k >= len(scores):
        return np.argsort(-scores, kind="stable")
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    places = np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])
    return places[np.lexsort((places, -scores[places]))]


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all embeddings for each whose vec_id is divisible by 20."""
    data = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return top_k(data, data.filter(F.col("id") % 20 == 0), 20)


ORACLE_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.r, q.vec_id AS query_id, s.vec_id, list_inner_product(q.v::DOUBLE[], s.v::DOUBLE[])::BIGINT AS score FROM v q JOIN v s ON q.vec_id % 20 = 0 AND q.r <> s.r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
