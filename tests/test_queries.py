"""Every query of the library against its SQL in DuckDB on the smallest tables, and the driver's contract."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from graintable import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return str(x)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = duck.execute(registry.ORACLES[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    key = lambda r: tuple(map(plain, r))
    assert sorted(map(key, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(key, got.fetchall()))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["knn_ivf", "knn_index"])
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_of_index_search(spark, size, name):
    want, got = ({tuple(r) for r in registry.QUERIES[n](spark, f"/root/testdata/{size}").select("query_id", "vec_id").collect()} for n in ("knn_exact", name))
    assert len(got & want) >= 0.9 * len(want)


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_nothing_else_imports_the_optional_subpackage():
    root = Path(registry.__file__).parent
    for p in root.rglob("*.py"):
        if p.relative_to(root).parts[0] != "llm":
            assert not [line for line in p.read_text().splitlines() if "import" in line and "llm" in line.split('"')[0]], p
