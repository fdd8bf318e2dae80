"""The vector index against brute force; vectors that can't be used."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graintable.operators import vector_index, vectors


def clusters(n: int, dims: int = 16, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    around = rng.normal(size=(20, dims)) * 4
    return (around[rng.integers(0, 20, n)] + rng.normal(size=(n, dims))).astype(np.float32)


def nearest(x: np.ndarray, queries: list[int], k: int) -> set[tuple[int, int]]:
    d = np.sqrt(((x[queries, None].astype(float) - x[None]) ** 2).sum(2)).round(6)
    return {(q, int(v)) for q, row in zip(queries, d, strict=True) for v in np.lexsort((np.arange(len(x)), row))[:k]}


@pytest.fixture(scope="module")
def table(spark):
    x = clusters(3000)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    asked = list(range(0, 3000, 100))
    return x, v, asked, v.filter(F.col("vec_id") % 100 == 0).withColumnRenamed("vec_id", "query_id")


def test_index_finds_the_neighbours(spark, table, tmp_path):
    x, v, asked, q = table
    index = vector_index.build_index(v, nlist=40, subspaces=8)
    vector_index.write_index(index, str(tmp_path / "index"))
    index = vector_index.read_index(spark, str(tmp_path / "index"))
    got = vector_index.search_index(q, index, v, k=10, nprobe=8).collect()
    found = {(r["query_id"], r["vec_id"]) for r in got}
    assert len(found & nearest(x, asked, 10)) >= 0.9 * 10 * len(asked)
    for r in got:
        assert abs(r["distance"] - np.linalg.norm(x[r["query_id"]].astype(float) - x[r["vec_id"]])) < 1e-5
    ids = np.concatenate([np.frombuffer(r["ids"], "int64") for r in index.blocks.collect()])
    assert sorted(ids) == list(range(3000))  # every row is indexed, once


def test_all_cells_and_the_whole_table_as_shortlist_are_exact(table):
    x, v, asked, q = table
    index = vector_index.build_index(v, nlist=10, subspaces=4, sample=500)
    got = {(r["query_id"], r["vec_id"]) for r in vector_index.search_index(q, index, v, 10, nprobe=100, shortlist=3000).collect()}
    assert got == nearest(x, asked, 10)


def test_a_crowded_region_gets_more_cells(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(2000, 8)), rng.normal(size=(200, 8)) + 50])
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    index = vector_index.build_index(v, nlist=44, subspaces=4)
    sizes = {r["cell"]: r["n"] for r in index.blocks.groupBy("cell").agg((F.sum(F.length("ids")) / 8).alias("n")).collect()}
    assert 35 <= len(index.centres) <= 50 and max(sizes.values()) <= 0.15 * len(x)


def test_vectors_that_cannot_be_used(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [1.0, None]), (5, [0.0, 1.0]), (6, [1.0, 2.0, 3.0]), (7, [1.0, 0.0]), (7, [5.0, 5.0]), (8, [2.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.withColumnRenamed("vec_id", "query_id").filter("query_id <> 7")
    index = vector_index.build_index(v, 4, 2)
    got = {(r["query_id"], r["rank"], r["vec_id"]) for r in vector_index.search_index(q, index, v, 2, nprobe=9).collect()}
    assert got == {(1, 1, 1), (1, 2, 7), (5, 1, 5), (5, 2, 1), (8, 1, 8), (8, 2, 1)}
    mean, matrix = vectors.fit_whitening(v, 2)
    white = vectors.apply_whitening(v, mean, matrix).collect()
    assert [r["vec_id"] for r in white if r["embedding"] is None] == [2, 3, 4, 6]
    celled, _ = vectors.build_ivf(v, 2)
    assert celled.count() == 5
    empty = v.limit(0)
    assert vector_index.search_index(q, vector_index.build_index(empty, 4), empty, 2).count() == 0


def test_exact_search_has_a_key_for_each_partition(spark, table):
    _, v, _, q = table
    plan = vectors.knn_exact(q.hint("merge"), v, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "salt" in plan.split("Join", 1)[1].split("\n", 1)[0]
