"""Embeddings and nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_DIMS = 32
Encoder = Callable[[Sequence[str]], np.ndarray]


def hashed_ngrams(dims: int = 256, low: int = 2, high: int = 3) -> Encoder:
    """The default encoder: character n-grams hashed to ``dims`` counts. Needs no model and is the same everywhere."""

    def encode(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for row, text in zip(out, texts, strict=True):
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            for n in range(low, high + 1):
                h = np.zeros(max(0, len(codes) - n + 1), np.uint64)
                for k in range(n):
                    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + codes[k : len(h) + k] + np.uint64(1)
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                sign = 1.0 - 2.0 * (h >> np.uint64(63)).astype(float)
                row += np.bincount((h >> np.uint64(20)).astype(np.int64) % dims, weights=sign, minlength=dims).astype(np.float32)
        return out

    return encode


def _normalised(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norms > 0, norms, 1)


def embed_texts(df: DataFrame, text: str = "text", make_encoder: Callable[[], Encoder] = hashed_ngrams, batch: int = 64, instruction: str | None = None, dims: int = 256) -> DataFrame:
    """df with embedding (unit length) and ok. The encoder is made once a task; a batch it fails on gets zero vectors and ok false; null texts too. With an instruction, it stands on a line before each text, as for queries."""
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("ok", T.BooleanType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for part in parts:
            vectors, ok = [], []
            texts = [None if t is None else t.replace("\n", " ").strip() for t in part[text]]
            for at in range(0, len(texts), batch):
                some = texts[at : at + batch]
                try:
                    found = _normalised(np.asarray(encode([f"{instruction}\n{t}" if instruction else t for t in map(lambda t: t or "", some)]), np.float32))
                    good = [t is not None for t in some]
                except Exception:
                    found, good = np.zeros((len(some), dims), np.float32), [False] * len(some)
                vectors += list(found)
                ok += good
            yield part[names].assign(embedding=vectors, ok=ok)

    return df.mapInPandas(run, schema)


def embed_queries(df: DataFrame, text: str = "query", instruction: str | None = "Given a question, find passages that answer it", **options) -> DataFrame:
    return embed_texts(df, text, instruction=instruction, **options)


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda a, x: a + x * x))


def l2_normalize(v: Column) -> Column:
    """Divided by its length; a zero vector stays."""
    n = norm(v)
    return F.transform(_doubles(v), lambda x: F.when(n > 0, x / n).otherwise(x))


def truncate_dims(v: Column, dims: int, least: int = LEAST_DIMS) -> Column:
    """The first dims components (at least ``least``) at unit length again; a vector that isn't longer stays as it is."""
    d = max(dims, least)
    return F.when(F.size(v) <= d, _doubles(v)).otherwise(l2_normalize(F.slice(v, 1, d)))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def usable(rows: DataFrame) -> DataFrame:
    """Rows whose embedding is there, not empty and without nulls; others take no part in searches."""
    return rows.filter(F.coalesce((F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull()), F.lit(False)))


def common_length(rows: DataFrame) -> tuple[int, int]:
    """The length most usable embeddings have (of equally many, the longest), and how many have it; 0 and 0 if there are none."""
    most = usable(rows).groupBy(F.size("embedding").alias("d")).count().agg(F.max(F.struct("count", "d")).alias("m")).first()["m"]
    return (most["d"], most["count"]) if most else (0, 0)


def of_length(rows: DataFrame, dims: int) -> DataFrame:
    """The usable rows whose embedding has this length."""
    return usable(rows).filter(F.size("embedding") == dims)


def packed(rows: DataFrame, key: str, block: int, cell: bool = False) -> DataFrame:
    """rows: ``key``, embedding. ids, vectors and dim: up to ``block`` vectors of one length, within their partition. With ``cell``, a column of rows: of one cell, too."""
    by = ["dim", *["cell"] * cell]

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for kind, alike in part.assign(dim=part["embedding"].map(len)).groupby(by):
                for at in range(0, len(alike), block):
                    some = alike.iloc[at : at + block]
                    x = np.stack([np.asarray(v, np.float32) for v in some["embedding"]])
                    yield pd.DataFrame({"ids": [some[key].to_numpy("int64").tobytes()], "vectors": [x.tobytes()], **{c: [v] for c, v in zip(by, kind, strict=True)}})

    return usable(rows.select(key, "embedding", *by[1:])).mapInPandas(pack, f"ids binary, vectors binary, {', '.join(f'{c} int' for c in by)}")


def knn_exact(queries: DataFrame, vectors: DataFrame, k: int = 20, digits: int = 6, block: int = 512) -> DataFrame:
    """queries: query_id, embedding (a stated set). vectors: vec_id, embedding. The k nearest by L2 distance: query_id, vec_id, distance, rank; ties by vec_id.

    Queries are packed to blocks, and every block meets every block of the vectors once, in a matrix product; of each meeting k rows
    a query are left. Blocks of vectors are dealt to salts by hash, and query blocks are copied to every salt, so that the join has as many keys as there
    are shuffle partitions, whatever the lengths. Distances are rounded before they are ranked, so that ties are ties on every engine. Vectors that are null, empty or hold a null
    take no part, and a query is compared to vectors of its own length only.
    """
    salts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _ranked(_met(packed(queries, "query_id", block), packed(vectors, "vec_id", 4096), ["dim"], salts, k, digits), k)


def _met(queries: DataFrame, vectors: DataFrame, on: list[str], salts: int, k: int, digits: int) -> DataFrame:
    """Blocks of both (``packed``). query_id, vec_id, distance: the k nearest of each query in each block of vectors that its own meets by ``on``."""
    blocks = queries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    data = vectors.withColumnsRenamed({"ids": "v_ids", "vectors": "v_vectors"}).withColumn("salt", F.pmod(F.xxhash64("v_ids"), F.lit(salts)).cast("int"))

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for ids, q, dim, v_ids, v in part[["ids", "vectors", "dim", "v_ids", "v_vectors"]].itertuples(index=False):
                ids, v_ids = np.frombuffer(ids, "int64"), np.frombuffer(v_ids, "int64")
                q, v = (np.frombuffer(x, np.float32).reshape(-1, dim).astype(float) for x in (q, v))
                d = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1) - 2 * q @ v.T, 0)).round(digits)
                last = np.partition(d, k - 1, axis=1)[:, k - 1] if k < len(v_ids) else np.full(len(ids), np.inf)
                best = []
                for row, most in zip(d, last, strict=True):
                    near = np.flatnonzero(~(row > most))
                    best.append(near[np.lexsort((v_ids[near], row[near]))[:k]])
                yield pd.DataFrame({"query_id": np.repeat(ids, [len(b) for b in best]), "vec_id": np.concatenate([v_ids[b] for b in best]), "distance": np.concatenate([row[b] for row, b in zip(d, best, strict=True)])})

    return data.join(blocks, [*on, "salt"]).mapInPandas(solve, "query_id long, vec_id long, distance double")


def _ranked(near: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return near.select("query_id", "vec_id", "distance", rank.alias("rank")).filter(F.col("rank") <= k)


def knn_staged(queries: DataFrame, vectors: DataFrame, stages: Sequence[tuple[int, int]], digits: int = 6) -> DataFrame:
    """stages: (dimensions, how many stay), coarse to fine. The first stage searches all vectors by a prefix, each next one only what the last left."""
    cut = lambda df, key, d: df.select(key, truncate_dims(F.col("embedding"), d, least=1).alias("embedding"))
    (d, k), *finer = stages
    found = knn_exact(cut(queries, "query_id", d), cut(vectors, "vec_id", d), k, digits)
    for d, k in finer:
        short = found.select("query_id", "vec_id")
        pairs = short.join(cut(queries, "query_id", d).withColumnRenamed("embedding", "q"), "query_id").join(cut(vectors, "vec_id", d), "vec_id")
        found = _ranked(pairs.select("query_id", "vec_id", F.round(F.sqrt(squared_distance(F.col("q"), F.col("embedding"))), digits).alias("distance")), k)
    return found


def build_ivf(vectors: DataFrame, nlist: int = 128, seed: int = 42, sample: int = 100_000) -> tuple[DataFrame, np.ndarray]:
    """The usable vectors of the commonest length with their cell, and the cells' centres. Centres are fitted on a bounded sample; every such vector gets a cell."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    dims, total = common_length(vectors)
    vectors = of_length(vectors, dims)
    some = vectors if total <= sample else vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(total)) < sample)
    model = KMeans(k=min(nlist, max(2, total)), seed=seed, featuresCol="f").fit(some.select(array_to_vector("embedding").alias("f")))
    centres = np.array(model.clusterCenters())
    return vectors.withColumn("cell", nearest_cell(F.col("embedding"), centres)), centres


def nearest_cell(v: Column, centres: np.ndarray) -> Column:
    @F.pandas_udf("int")
    def cell(vs: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(v, float) for v in vs]) if len(vs) else np.zeros((0, centres.shape[1]))
        return pd.Series(((centres**2).sum(1) - 2 * x @ centres.T).argmin(1) if len(x) else [], dtype="int32")

    return cell(v)


def knn_ivf(queries: DataFrame, celled: DataFrame, centres: np.ndarray, k: int = 20, nprobe: int = 10, digits: int = 6) -> DataFrame:
    """As knn_exact, block by block, but each query meets only the vectors of its nprobe nearest cells."""
    n = min(nprobe, len(centres))

    @F.pandas_udf("array<int>")
    def probe(vs: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(v, float) for v in vs])
        return pd.Series(list(((centres**2).sum(1) - 2 * x @ centres.T).argsort(1)[:, :n].astype("int32")))

    asked = of_length(queries, centres.shape[1]).select("query_id", "embedding", F.explode(probe("embedding")).alias("cell"))
    # a cell's vectors are dealt to salts, so that there are about as many keys as shuffle partitions
    salts = -(-int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")) // len(centres))
    return _ranked(_met(packed(asked, "query_id", 512, cell=True), packed(celled, "vec_id", 4096, cell=True), ["dim", "cell"], salts, k, digits), k)


def fit_whitening(vectors: DataFrame, components: int = 384) -> tuple[np.ndarray, np.ndarray]:
    """Mean and matrix that take the vectors to uncorrelated components of variance 1. A partition gives its sums; the driver sees one d x d matrix.

    Fitted on the usable vectors of the commonest length; there must be two of them.
    """

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, ss = 0, None, None
        for part in parts:
            if len(part):
                x = np.stack([np.asarray(v, float) for v in part["embedding"]])
                n += len(x)
                s = x.sum(0) if s is None else s + x.sum(0)
                ss = x.T @ x if ss is None else ss + x.T @ x
        if n:
            flat = np.concatenate([[n], s, ss.ravel()])
            yield pd.DataFrame({"i": np.arange(len(flat)), "v": flat})

    dims, rows = common_length(vectors)
    if rows < 2:
        raise ValueError("whitening needs two vectors of one length")
    total = of_length(vectors.select("embedding"), dims).mapInPandas(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")["v"].to_numpy()
    n, mean, ss = total[0], total[1 : dims + 1] / total[0], total[dims + 1 :].reshape(dims, dims)
    u, s, _ = np.linalg.svd((ss - n * np.outer(mean, mean)) / (n - 1))
    return mean, (u / np.sqrt(np.maximum(s, 1e-12)))[:, :components]


def apply_whitening(vectors: DataFrame, mean: np.ndarray, matrix: np.ndarray, column: str = "embedding") -> DataFrame:
    """The column whitened; null where the vector is null, holds a null or is of another length than those fitted."""

    @F.pandas_udf("array<double>")
    def whiten(vs: pd.Series) -> pd.Series:
        fits = [v is not None and len(v) == len(mean) and not np.isnan(np.asarray(v, float)).any() for v in vs]
        done = iter((np.array([np.asarray(v, float) for v, ok in zip(vs, fits, strict=True) if ok]).reshape(-1, len(mean)) - mean) @ matrix)
        return pd.Series([next(done) if ok else None for ok in fits], dtype=object)

    return vectors.withColumn(column, whiten(column))
