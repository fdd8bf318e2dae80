"""A vector index that is built once and searched often: balanced cells, product-quantised codes, exact re-ranking.

Cells come in two levels. A sample is split by k-means into roots, and each root, in a task of its own, into as many cells as its
share of the sample asks for; so crowded regions get more cells, and cells hold like numbers of vectors. A vector is coded by what is
left of it after its cell's centre is taken off: its components fall into subspaces, and in each the nearest of 256 codewords is
noted, one byte. Codes of a cell lie in blocks. A search meets, for each query, the blocks of its nearest cells, adds up distances from
a table of the query's distance to every codeword, keeps a shortlist for each query, and ranks that by exact distances.

Only fitting uses a sample (``sample`` rows in expectation, drawn by hash); every usable vector is indexed. Centres and codewords are what
the driver sees: nlist + 256 vectors. A cell of any size is cut into blocks, and adaptive execution cuts its partition.

Vectors that are null, empty, hold a null, or are of another length than most take no part; of repeated ids every row is a candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import durable
from .vectors import _ranked, common_length, nearest_cell, of_length, squared_distance

CODES = 256
BLOCK = 4096


@dataclass(frozen=True)
class VectorIndex:
    """blocks: cell, ids, codes (packed). centres: cells x dims. books: subspaces x codes x dims of a subspace."""

    blocks: DataFrame
    centres: np.ndarray
    books: np.ndarray


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """k centres of the rows (fewer, if there are fewer different rows). A centre that loses all its rows stays where it is."""
    different = np.unique(x, axis=0)
    if len(different) <= k:
        return different
    centres = different[np.random.default_rng(seed).choice(len(different), k, replace=False)].astype(float)
    for _ in range(rounds):
        nearest = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        counts = np.bincount(nearest, minlength=len(centres))
        sums = np.stack([np.bincount(nearest, weights=column, minlength=len(centres)) for column in x.T], axis=1)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _stack(values: pd.Series, dims: int) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in values]) if len(values) else np.zeros((0, dims))


def _centres(groups: DataFrame, key: str, dims: int, how_many, seed: int) -> np.ndarray:
    """Centres of each group of the sample, in the order of the groups; ``how_many`` tells a group's number from its rows."""

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        x = _stack(part["embedding"], dims)
        found = k_means(x, how_many(len(x)), seed)
        return pd.DataFrame({"g": int(part[key].iloc[0]), "i": range(len(found)), "centre": list(found)})

    rows = groups.groupBy(key).applyInPandas(fit, "g int, i int, centre array<double>").collect()
    return np.array([r["centre"] for r in sorted(rows, key=lambda r: (r["g"], r["i"]))], float).reshape(len(rows), dims)


def build_index(vectors: DataFrame, nlist: int = 128, subspaces: int = 16, seed: int = 42, sample: int = 100_000) -> VectorIndex:
    """vectors: vec_id, embedding."""
    spark = vectors.sparkSession
    dims, total = common_length(vectors)
    vectors = of_length(vectors.select("vec_id", "embedding"), dims)
    m = max(d for d in range(1, min(subspaces, max(dims, 1)) + 1) if dims % d == 0)
    drawn = vectors if total <= sample else vectors.filter(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(total)) < sample)
    drawn = durable(drawn.dropDuplicates(), "index-sample")
    rows = drawn.count()
    roots = _centres(drawn.withColumn("g", F.lit(0)), "g", dims, lambda n: max(1, round(nlist**0.5)), seed)
    if not len(roots):
        return VectorIndex(spark.createDataFrame([], "cell int, ids binary, codes binary"), np.zeros((0, dims)), np.zeros((m, 0, dims // m)))
    rooted = drawn.select("embedding", nearest_cell(F.col("embedding"), roots).alias("root"))
    centres = _centres(rooted, "root", dims, lambda n: max(1, round(nlist * n / rows)), seed)
    books = _books(drawn, centres, m, seed)
    return VectorIndex(_blocks(vectors, centres, books), centres, books)


def _residuals(x: np.ndarray, centres: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    cells = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
    return cells, (x - centres[cells]).reshape(len(x), m, -1)


def _books(drawn: DataFrame, centres: np.ndarray, m: int, seed: int) -> np.ndarray:
    """The codewords of each subspace, each fitted in a task of its own; padded with the last where there are fewer."""
    width = centres.shape[1] // m

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            _, left = _residuals(_stack(part["embedding"], centres.shape[1]), centres, m)
            yield pd.DataFrame({"subspace": np.tile(np.arange(m), len(left)), "embedding": list(left.reshape(-1, width))})

    pieces = drawn.select("embedding").mapInPandas(cut, "subspace int, embedding array<double>")

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        found = k_means(_stack(part["embedding"], width), CODES, seed)
        found = found[np.minimum(np.arange(CODES), len(found) - 1)]
        return pd.DataFrame({"subspace": int(part["subspace"].iloc[0]), "code": range(CODES), "word": list(found)})

    rows = pieces.groupBy("subspace").applyInPandas(fit, "subspace int, code int, word array<double>").collect()
    return np.array([r["word"] for r in sorted(rows, key=lambda r: (r["subspace"], r["code"]))]).reshape(m, CODES, width)


def _blocks(vectors: DataFrame, centres: np.ndarray, books: np.ndarray) -> DataFrame:
    dims, m = centres.shape[1], len(books)

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            cells, left = _residuals(_stack(part["embedding"], dims), centres, m)
            codes = np.stack([((book**2).sum(1) - 2 * left[:, j] @ book.T).argmin(1) for j, book in enumerate(books)], axis=1).astype(np.uint8)
            yield pd.DataFrame({"cell": cells.astype("int32"), "vec_id": part["vec_id"], "code": [c.tobytes() for c in codes]})

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for cell, rows in part.groupby("cell"):
                for at in range(0, len(rows), BLOCK):
                    some = rows.iloc[at : at + BLOCK]
                    yield pd.DataFrame({"cell": [cell], "ids": [some["vec_id"].to_numpy("int64").tobytes()], "codes": [b"".join(some["code"])]})

    coded = vectors.mapInPandas(encode, "cell int, vec_id long, code binary")
    return coded.hint("rebalance", "cell").sortWithinPartitions("cell", "vec_id").mapInPandas(pack, "cell int, ids binary, codes binary")


def write_index(index: VectorIndex, path: str) -> None:
    """Blocks as Parquet; centres and codewords as one small table beside them."""
    spark = index.blocks.sparkSession
    index.blocks.write.mode("overwrite").parquet(f"{path}/blocks")
    model = [(name, list(map(int, x.shape)), x.ravel().tolist()) for name, x in (("centres", index.centres), ("books", index.books))]
    spark.createDataFrame(model, "name string, shape array<int>, x array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def read_index(spark: SparkSession, path: str) -> VectorIndex:
    model = {r["name"]: np.array(r["x"], float).reshape(r["shape"]) for r in spark.read.parquet(f"{path}/model").collect()}
    return VectorIndex(spark.read.parquet(f"{path}/blocks"), model["centres"], model["books"])


def search_index(queries: DataFrame, index: VectorIndex, vectors: DataFrame, k: int = 20, nprobe: int = 10, shortlist: int | None = None, digits: int = 6, block: int = 512) -> DataFrame:
    """queries: query_id, embedding. As ``knn_exact`` among a query's shortlist (10 k by default): query_id, vec_id, distance, rank."""
    centres, books = index.centres, index.books
    dims, m, n = centres.shape[1], len(books), min(nprobe, len(centres))
    keep = shortlist or 10 * k

    def probe(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = _stack(part["embedding"], dims)
            cells = ((centres**2).sum(1) - 2 * x @ centres.T).argsort(1, kind="stable")[:, :n]
            yield pd.DataFrame({"cell": cells.ravel().astype("int32"), "query_id": np.repeat(part["query_id"].to_numpy(), n), "q": [v.tobytes() for v in np.repeat(x, n, axis=0)]})

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for cell, rows in part.groupby("cell"):
                for at in range(0, len(rows), block):
                    some = rows.iloc[at : at + block]
                    yield pd.DataFrame({"cell": [cell], "q_ids": [some["query_id"].to_numpy("int64").tobytes()], "q": [b"".join(some["q"])]})

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for cell, ids, codes, q_ids, q in part[["cell", "ids", "codes", "q_ids", "q"]].itertuples(index=False):
                ids, q_ids, codes = np.frombuffer(ids, "int64"), np.frombuffer(q_ids, "int64"), np.frombuffer(codes, np.uint8).reshape(-1, m)
                left = (np.frombuffer(q, float).reshape(-1, dims) - centres[cell]).reshape(len(q_ids), m, -1)
                near = np.zeros((len(q_ids), len(ids)), np.float32)
                for j, book in enumerate(books):
                    table = ((left[:, j, None] - book) ** 2).sum(2).astype(np.float32)
                    near += table[:, codes[:, j]]
                top = np.argpartition(near, keep - 1, axis=1)[:, :keep] if keep < len(ids) else np.tile(np.arange(len(ids)), (len(q_ids), 1))
                yield pd.DataFrame({"query_id": np.repeat(q_ids, top.shape[1]), "vec_id": ids[top].ravel(), "distance": np.take_along_axis(near, top, 1).ravel().astype(float)})

    asked = of_length(queries.select("query_id", "embedding"), dims)
    packed = asked.mapInPandas(probe, "cell int, query_id long, q binary").hint("rebalance", "cell").sortWithinPartitions("cell", "query_id").mapInPandas(pack, "cell int, q_ids binary, q binary")
    rough = _ranked(index.blocks.join(packed, "cell").mapInPandas(scan, "query_id long, vec_id long, distance double"), keep)
    pairs = rough.select("query_id", "vec_id").distinct().join(asked.withColumnRenamed("embedding", "q"), "query_id").join(of_length(vectors.select("vec_id", "embedding"), dims), "vec_id")
    return _ranked(pairs.select("query_id", "vec_id", F.round(F.sqrt(squared_distance(F.col("q"), F.col("embedding"))), digits).alias("distance")), k)
